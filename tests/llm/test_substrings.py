from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stridemill.llm import queries, substrings
from stridemill.llm.text import from_planes, hash_spans, planes, window_hashes, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """(id, text) rows to kept texts; equal rows are one document, texts of one id in order of their digests."""
    halves = lambda t: [int.from_bytes(hashlib.md5(t.encode()).digest()[k : k + 8], "big", signed=True) for k in (0, 8)]
    docs = sorted({(-(2**63) if i is None else i, t or "") for i, t in rows}, key=lambda r: (r[0], halves(r[1])))
    seen, out = {}, {}
    order = [(i, t, WORD.findall(t)) for i, t in docs]
    for i, t, words in order:
        for s in range(len(words) - window + 1):
            seen.setdefault(tuple(words[s : s + window]), (i, s, t))
    for i, t, words in order:
        gone = set()
        for s in range(len(words) - window + 1):
            if seen[tuple(words[s : s + window])] != (i, s, t):
                gone.update(range(s, s + window))
        out[i, t] = [w for k, w in enumerate(words) if k not in gone], len(words), len(gone)
    return out


def check(spark, rows, window, **limits):
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING, spans STRING, row INT, id LONG, n_words INT") if len(
        rows[0]
    ) == 6 else spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = substrings.remove_repeated_windows(frame, window=window, **limits).collect()
    results = brute([r[:2] for r in rows], window)
    want = []
    for i, t, *_ in rows:
        words, n, gone = results[-(2**63) if i is None else i, t or ""]
        want.append((i is not None, i or 0, " ".join(words), n, gone))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.n_words, r.n_removed) for r in got) == sorted(want)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def random_rows(seed=1, n=60):
    rng = np.random.default_rng(seed)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for i in range(n):
        words = [f"w{rng.integers(0, 6)}" for _ in range(rng.integers(0, 40))]
        if i % 3 == 0:
            at = rng.integers(0, len(words) + 1)
            words[at:at] = passage[rng.integers(0, 10) :]
        rows.append((int(i), " ".join(words)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"group_bytes": 500, "block_windows": 40}])
def test_against_brute_force(spark, limits):
    check(spark, random_rows(), 5, **limits)


def test_edges(spark):
    long = " ".join(f"x{k % 50}" for k in range(20_000))
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "a b c"), (5, "a b c a b c"), (5, "a b c a b c"), (6, "c a b c\x0bd é"),
        (None, "a b c z"), (7, long), (8, long), (9, "é" * 5000 + " b c"), (10, "x" * 30_000 + " a b"), (6, "c a b q"),
        (11, "a\xa0b c d e"), (12, "a\xa0b c d e"),
    ]
    check(spark, rows, 3, group_bytes=5000, block_windows=100)


def test_clashing_columns_and_empty(spark):
    check(spark, [(1, "a b c d", "s", 1, 2, 3), (2, "a b c x", "s", 1, 2, 3)], 3)
    empty = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert substrings.remove_repeated_windows(empty).count() == 0


def test_settled_windows_go_by_document():
    """800 documents begin with one header: each block settles its copies, and no part gathers them."""
    rng = np.random.default_rng(4)
    header = " ".join(f"h{k}" for k in range(60))
    texts = [header + " " + " ".join(f"w{i}x{k}" for k in range(30)) for i in range(800)]
    sizes = Counter()
    for k in range(0, 800, 100):
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, k + 100)), pa.array(rng.integers(0, 2**62, 100)), pa.array(np.zeros(100, np.int64)), pa.array(texts[k : k + 100])],
            ["id", "check", "more", "text"],
        )
        for out in substrings._entries(20, 4000, 10**6)(iter([batch])):
            for row in out.to_pylist():
                if not row["hashes"]:
                    sizes[row["part"]] += len(substrings._unpack(row)[2])
    assert sum(sizes.values()) == 8 * 99 * 41
    assert max(sizes.values()) < sum(sizes.values()) // 4


def test_two_texts_of_one_id_with_equal_crc32(spark):
    tail = " ".join(f"w{k}" for k in range(40))
    a, b = "plumless " + tail, "buckeroo " + tail
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    check(spark, [(7, a), (7, b), (None, "x " + a), (None, tail[40:]), (2, "w3 w4 w5 w6 w7")], 4, block_windows=30)


def test_an_id_column_named_like_a_result_is_refused(spark):
    frame = spark.createDataFrame([(1, "a b c")], "n_words LONG, text STRING")
    with pytest.raises(ValueError):
        substrings.remove_repeated_windows(frame, id="n_words")


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 20)
    got = queries.QUERIES["op6_substring_dedup"](spark, data).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        words, n, gone = want[r.doc_id, text[r.doc_id]]
        sha = hashlib.sha256(" ".join(words).encode()).hexdigest()
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, sha)


def test_helpers():
    texts = ["ab  c", "", "\tdef ghi ", "x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    a, b, first = word_spans(data, offsets)
    assert [bytes(data[i:j]).decode() for i, j in zip(a, b)] == ["ab", "c", "def", "ghi", "x"]
    assert list(first) == [0, 2, 2, 4, 5]
    assert len(set(hash_spans(data, a, b))) == 5
    values = np.arange(50, dtype=np.uint64) % np.uint64(7)
    for size in (1, 2, 3, 8, 20, 50):
        h = window_hashes(values, size, 12345)
        want = [sum(int(values[i + j]) * pow(12345, size - 1 - j, 2**64) for j in range(size)) % 2**64 for i in range(51 - size)]
        assert [int(x) for x in h] == want
    assert len(window_hashes(values, 51, 3)) == 0
    numbers = np.array([0, 5, -7, 2**40], np.int64)
    assert (from_planes(planes(numbers), np.int64) == numbers).all()
