from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from stridemill.llm import queries, suffixes


def slow_suffixes(s, unique):
    tagged = [(0, i) if c < unique else (1, c) for i, c in enumerate(s)]
    return sorted(range(len(s)), key=lambda i: tagged[i:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80), st.integers(1, 4))
def test_suffix_array(body, top):
    s = np.array([min(c, top) for c in body] + [0])
    assert suffixes.suffix_array(s, 5).tolist() == slow_suffixes(s.tolist(), 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=9))
def test_suffix_array_with_separators(parts):
    s = np.array([c for p in parts for c in [*p, 0]])
    assert suffixes.suffix_array(s, 4, unique=1).tolist() == slow_suffixes(s.tolist(), 1)


def test_recursion_by_induction(monkeypatch):
    rng = np.random.default_rng(1)
    calls = []
    real = suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    s = np.r_[np.tile(rng.integers(1, 3, 40), 30), 0]
    assert suffixes.suffix_array(s, 3).tolist() == slow_suffixes(s.tolist(), 0)
    assert len(calls) > 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30).map(bytes), min_size=1, max_size=6, unique=True), st.integers(1, 6))
def test_repeated_starts(texts, length):
    where = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    texts = [t for t in texts if t]
    want = [[where[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]
    if texts:
        assert [h.tolist() for h in suffixes.repeated_starts(texts, length)] == want


def test_anchors_follow_the_content(monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 50)
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 30, 39, 40, 41, 300, 7, 170)]
    texts.append(b"x" + texts[5][20:280])
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    row, start, number, h = suffixes.anchors(data, offsets, 40, 12)
    seen, by_window = Counter(), {}
    for r, s, n, x in zip(row, start, number, h):
        for k in range(s, s + n):
            seen[int(r), int(k)] += 1
            assert by_window.setdefault(texts[r][k : k + 40], x) == x
    assert seen == Counter((r, k) for r, t in enumerate(texts) for k in range(len(t) - 39))


def brute(rows, length):
    docs = {(i, (t or "").encode()) for i, t in rows}
    count = Counter(t[k : k + length] for _, t in docs for k in range(len(t) - length + 1))
    out = {}
    for i, t in docs:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i, t] = bytes(b for b, g in zip(t, gone) if not g), len(t), int(gone.sum()), spans
    return out


def check(spark, rows, length, **limits):
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id LONG, text STRING, part INT, kept STRING")
    got = suffixes.remove_repeated_bytes(frame, length=length, **limits).collect()
    results = brute(rows, length)
    want = sorted((i is not None, i or 0, *results[i, (t or "").encode()]) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.kept), r.n_bytes, r.n_removed, len(r.spans)) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def rows_with_repeats(seed=1, n=50):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(40)]
    passages = ["".join(rng.choice(list("abcdé "), 90)) for _ in range(4)]
    rows = []
    for i in range(n):
        body = " ".join(rng.choice(words, rng.integers(0, 60)))
        if i % 3 == 0:
            at = int(rng.integers(0, len(body) + 1))
            body = body[:at] + passages[int(rng.integers(0, 4))][int(rng.integers(0, 30)) :] + body[at:]
        rows.append((i, body))
    return rows


@pytest.mark.parametrize("limits", [{}, {"group_bytes": 900, "block_anchors": 7, "block_bytes": 300, "array_bytes": 100}])
def test_against_brute_force(spark, limits):
    check(spark, rows_with_repeats(), 25, **limits)


@pytest.mark.parametrize("limits", [{}, {"group_bytes": 3000, "block_anchors": 11, "block_bytes": 900, "array_bytes": 60}])
def test_edges(spark, limits):
    base = "".join(chr(97 + k * k % 26) for k in range(120))
    rows = [
        (1, None), (2, ""), (3, "short"), (4, base), (5, base), (5, base), (6, "q" + base[10:90] + "r"), (7, "a" * 500),
        (8, "ab" * 300), (None, base[:50]), (9, "é" * 100), (10, "x" * 20 + "\x00" * 60 + "y" * 20), (11, "\x00" * 50),
        (12, base[::-1] * 3), (6, "other text of the same id, long enough to be looked at"), (13, "z" * 30),
    ]
    check(spark, rows, 20, **limits)


def test_one_document_given_twice_is_not_repeated(spark):
    text = "".join(chr(97 + (k * 7919) % 26) for k in range(26))
    check(spark, [(1, text), (1, text)], 20)


def test_empty(spark):
    assert suffixes.remove_repeated_bytes(spark.createDataFrame([], "doc_id LONG, text STRING")).count() == 0


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    results = brute(rows, 200)
    got = queries.QUERIES["op9_suffix_dedup"](spark, data).collect()
    want = {i: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for (i, _), (kept, n, gone, spans) in results.items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def around_a_line(n=200):
    """A line of 150 bytes with other neighbours in each text, longer in a few: those repeat."""
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghij klmnop"))
    some = lambda k: "".join(rng.choice(letters, k))
    line, longer = some(150), some(40)
    return [(i, some(150) + line + (longer if i % 20 == 0 else "") + some(150)) for i in range(n)]


def test_a_frequent_line_does_not_gather_its_surroundings(spark):
    rows = around_a_line()
    frame = spark.createDataFrame(rows, "id LONG, text STRING").withColumns({"check": F.xxhash64("text"), "more": F.lit(0).cast("long")})
    size = sum(len(t) for _, t in rows)
    hot = suffixes.hot_anchors(frame, 180, 57, size, 4000)
    assert len(hot) and not len(suffixes.hot_anchors(frame, 180, 57, size, 1 << 20))
    batch = frame.select("id", "check", "more", "text").toArrow().combine_chunks().to_batches()[0]
    found = pa.Table.from_batches(suffixes._find_anchors(180, 57, 1, 10**6, SimpleNamespace(value=hot))(iter([batch])))
    distinct = {}
    for row in suffixes._shared_anchors(1)(found).to_pylist():
        for i, _, _, start, n, h in zip(*(x.tolist() for x in suffixes._read(row, *suffixes._ANCHORS))):
            distinct.setdefault(h, set()).add(rows[i][1][start : start + n + 179])
    assert distinct and max(sum(map(len, texts)) for texts in distinct.values()) < 2 * 4000
    check(spark, rows, 180, array_bytes=4000, group_bytes=5000, block_anchors=50, block_bytes=4000)


def spread(rows, names=("id",)):
    sizes = Counter()
    for row in rows:
        sizes[row["part"]] += len(suffixes._read(row, *names)[0])
    return sizes


def test_marked_anchors_go_by_document():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdef"), 100))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(400)), pa.array(np.zeros(400, np.int64)), pa.array(np.zeros(400, np.int64)), pa.array([text] * 400)],
        ["id", "check", "more", "text"],
    )
    none = SimpleNamespace(value=np.zeros(0, np.uint64))
    found = suffixes._find_anchors(90, 28, 16, 10**6, none)(iter([batch]))
    sizes = spread([row for part in found for row in part.to_pylist()])
    assert max(sizes.values()) < sum(sizes.values()) // 4


def test_settled_segments_go_by_document():
    """600 documents begin alike; in each block their equal segments are settled at once."""
    rng = np.random.default_rng(5)
    head = "".join(rng.choice(list("abcdefgh "), 260))
    blob = lambda values, kind: np.array(values, kind).tobytes()
    batches = []
    for k in range(6):
        ids = np.arange(100 * k, 100 * k + 100)
        texts = [head + "".join(rng.choice(list("ijklmnop "), 50)) for _ in ids]
        one = [blob([0, 30], "<u4"), blob([30, 31], "<u4"), blob([7, 9], "<u8")]
        columns = [pa.array(ids), pa.array(rng.integers(0, 2**62, 100)), pa.array(np.zeros(100, np.int64)), pa.array(texts)]
        columns += [pa.array([x] * 100, pa.binary()) for x in one]
        batches.append(pa.RecordBatch.from_arrays(columns, ["id", "check", "more", "text", "start", "size", "hash"]))
    rows = [r for b in batches for out in suffixes._cut_segments(200, 400, 1 << 30)(iter([b])) for r in out.to_pylist()]
    sizes = spread([r for r in rows if not r["lengths"]])
    assert sum(sizes.values()) == 6 * 2 * 100
    assert max(sizes.values()) < sum(sizes.values()) // 4


def test_two_texts_of_one_id_with_equal_crc32(spark):
    tail = "".join(chr(97 + (k * 7919 + k // 26) % 26) for k in range(70))
    a, b = "plumless" + tail, "buckeroo" + tail
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    check(spark, [(7, a), (7, b), (None, a + "!"), (None, "x" + b), (9, tail[:40])], 25)


def test_a_very_long_text(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(2000)]
    long = " ".join(rng.choice(words, 12_000))
    check(spark, [(1, long), (2, long[30_000:30_400] + " other"), (3, "own " * 3 + long[:150])], 120, group_bytes=20_000, block_anchors=300)


def test_the_limit_of_hot_anchors_grows_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MOST_HOT", 2)
    frame = spark.createDataFrame(around_a_line(60), "id LONG, text STRING").withColumn("check", F.xxhash64("text"))
    size = frame.agg(F.sum(F.length("text"))).first()[0]
    assert not len(suffixes.hot_anchors(frame, 180, 57, size * 100, 1000))
