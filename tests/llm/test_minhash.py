from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stridemill.llm import minhash, queries
from stridemill.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_weights(texts, size=5):
    """Weighted shingles by the definition; idf by hashed words, as documented."""
    idf = brute_idf(texts)
    out = []
    for t in texts:
        words = WORD.findall(t or "")
        n = len(words)
        grams = [tuple(words[i : i + size]) for i in range(n - size + 1)] if n >= size else [tuple(words)] if n else []
        out.append({g: c * np.mean([idf[w] for w in g]) for g, c in Counter(grams).items()})
    return out


def brute_idf(texts):
    from stridemill.llm.text import hash_spans

    words = sorted({w for t in texts for w in WORD.findall(t or "")})
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words]) if words else np.zeros(0, int)
    starts = np.r_[0, ends[:-1]] if words else ends
    bucket = dict(zip(words, (hash_spans(data, starts, ends) >> np.uint64(64 - minhash.WORD_BITS)).tolist()))
    n = Counter(b for t in texts for b in {bucket[w] for w in WORD.findall(t or "")})
    total = len(texts)
    return {w: 1 + np.log((1 + total) / (1 + n[bucket[w]])) / np.log(1 + total) for w in words}


def similarity(a, b):
    shared = sum(min(w, b[g]) for g, w in a.items() if g in b)
    whole = sum(a.values()) + sum(b.values()) - shared
    return shared / whole if whole else 0.0


def brute_classes(rows, least=0.8):
    """Connected by similarity or equality of texts; null texts stand alone."""
    distinct = sorted({t for _, t in rows if t is not None})
    weights = dict(zip(distinct, brute_weights([t for _, t in rows if t is not None])))
    idf_all = brute_weights([t for _, t in rows])
    weights = {t: w for (_, t), w in zip(rows, idf_all) if t is not None}
    owner = {}
    for i, t in rows:
        if t is not None:
            owner[t] = min(i, owner.get(t, i))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for i, t in rows:
        if t is not None:
            join(i, owner[t])
    border = []
    for k, s in enumerate(distinct):
        for t in distinct[k + 1 :]:
            j = similarity(weights[s], weights[t])
            if j >= least:
                join(owner[s], owner[t])
            if abs(j - least) < 1e-6:
                border.append((s, t))
    return {i: find(i) for i, _ in rows}, border


def corpus(seed=2, groups=25, vocabulary=400):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for _ in range(groups):
        base = [f"w{int(x)}" for x in rng.integers(0, vocabulary, rng.integers(30, 200))]
        rows.append((k, " ".join(base)))
        k += 1
        for _ in range(int(rng.integers(0, 4))):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 3))):
                copy[at] = f"new{int(rng.integers(0, 1000))}"
            rows.append((k, " ".join(copy)))
            k += 1
    return rows


@pytest.mark.parametrize("block", [512, 2])
def test_against_brute_force(spark, block):
    rows = corpus()
    rows += [(500 + k, " ".join(f"z{(j if j != k else 999 + k)}" for j in range(300))) for k in range(40)]
    want, border = brute_classes(rows)
    assert not border
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(frame, block=block).collect()}
    assert got == want


def test_shingle_weights():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 5, n)) for n in (0, 1, 3, 4, 5, 6, 40, 200)] + ["é ü  é ü é ü\n" * 9]
    idf = np.ones(1 << minhash.WORD_BITS, np.float32)
    features, weights, first = minhash.shingles(pa.array(texts), idf, 5)
    for t, a, b in zip(texts, first[:-1], first[1:]):
        words = WORD.findall(t)
        n = len(words)
        grams = Counter(tuple(words[i : i + 5]) for i in range(max(n - 4, min(n, 1))))
        assert sorted(weights[a:b]) == sorted(grams.values()) and len(set(features[a:b].tolist())) == len(grams)


def test_samples_agree_as_weighted_jaccard():
    rng = np.random.default_rng(8)
    features = np.arange(300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = rng.random(300) * 3 + 0.1, rng.random(300) * 3 + 0.1
    keep_a, keep_b = np.arange(0, 260), np.arange(60, 300)
    b[60:260] = a[60:260] * rng.choice([1.0, 0.6], 200)
    f = np.r_[features[keep_a], features[keep_b]]
    w = np.r_[a[keep_a], b[keep_b]]
    s = minhash.consistent_samples(f, w, np.array([0, len(keep_a), len(f)]), 4000, 3)
    whole_a, whole_b = np.zeros(300), np.zeros(300)
    whole_a[keep_a], whole_b[keep_b] = a[keep_a], b[keep_b]
    want = np.minimum(whole_a, whole_b).sum() / np.maximum(whole_a, whole_b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_edges(spark):
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [
        (1, None), (2, None), (3, ""), (4, ""), (5, " \n"), (6, "a b"), (7, "a  b"), (8, "a b c d e f"), (9, "b a"),
        (10, long), (11, long + " more"), (12, "a b c d e f"), (12, "a b c d e f"), (13, "é " * 50), (None, "é " * 50),
    ]
    frame = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id LONG, text STRING, class_id INT, kept STRING")
    got = minhash.near_duplicates(frame).collect()
    assert sorted((r.doc_id or 0, r.class_id) for r in got) == sorted(
        [(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6), (8, 8), (9, 9), (10, 10), (11, 10), (12, 8), (12, 8), (13, None), (0, None)],
        key=lambda p: (p[0], p[1] or -1),
    ) or sorted((r.doc_id or 0, r.class_id or 0) for r in got) == sorted(
        [(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6), (8, 8), (9, 9), (10, 10), (11, 10), (12, 8), (12, 8), (13, 0), (0, 0)]
    )
    kept = minhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 8, 9, 10]
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "q")], "doc_id LONG, text STRING")
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(twice).collect()) == [1, 2]
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    texts = [" ".join(f"{a}{k}" for k in range(60)) for a in "pqrst"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[1] + " more"), (8, texts[3]), (9, texts[2])]
    rows += [(8, texts[4]), (8, texts[4] + " more"), (10, texts[4]), (11, None), (11, texts[3] + " more"), (None, None), (8, texts[3])]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = [tuple(r) for r in minhash.near_duplicates(frame).select("doc_id", "class_id").collect()]
    want = [(None, None)] * 4 + [(7, None), (9, None)] + [(8, 8)] * 4 + [(10, 8), (11, 11), (11, 8)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    left = [(r.doc_id, r.text) for r in minhash.drop_near_duplicates(frame).collect()]
    firm = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (8, texts[3]), (11, None), (None, None)]
    assert len(left) == len(firm) + 1 and set(firm) < set(left)
    assert (set(left) - set(firm)) < {(8, texts[4]), (8, texts[4] + " more")}


def test_components(spark):
    rng = np.random.default_rng(4)
    chain = [(k, k + 1) for k in range(100, 160)]
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))] + chain + [(5, 5), (None, 3)] + [(200, k) for k in range(201, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a LONG, b LONG")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {k: find(k) for k in root}
    assert components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want, border = brute_classes(rows)
    got = {r.doc_id: (r.class_id, r.kept) for r in queries.QUERIES["op1_minhash_dedup"](spark, data).collect()}
    assert got == {i: (c, c == i) for i, c in want.items()}


def test_second_round_sends_the_dominant_class_once(spark):
    """A bucket of 4,000 texts of one class and 3 strangers: rows sent are few more than members."""
    rows = [(1, i % 8, i, 7) for i in range(4000)] + [(1, i % 8, 5000 + i, 5000 + i) for i in range(3)]
    rows += [(2, i % 2, 9000 + i, 9000) for i in range(50)]  # one class only: not looked at again
    labelled = spark.createDataFrame(rows, "bucket LONG, block INT, id LONG, label LONG")
    sent = minhash._strangers(labelled, 512)
    assert sent.where("bucket = 2").count() == 0
    assert sent.count() <= 4000 + 3 * 8 + 3
    assert sent.groupBy("bucket", "block").count().agg({"count": "max"}).first()[0] <= 503


def test_every_pair_of_different_classes_meets(spark):
    rng = np.random.default_rng(2)
    rows = [(b, int(rng.integers(0, 4)), 100 * b + i, 100 * b + int(rng.choice([0, 0, 0, 1, 2, 3 + i]))) for b in range(3) for i in range(60)]
    labelled = spark.createDataFrame(rows, "bucket LONG, block INT, id LONG, label LONG")
    for size in (4, 512):
        groups = {}
        for r in minhash._strangers(labelled, size).collect():
            groups.setdefault((r.bucket, r.block), []).append((r.id, r.label, r.side))
        met = {
            frozenset((a[0], b[0])) for g in groups.values() for a in g for b in g
            if a[0] < b[0] and (a[2] < 0 or a[2] != b[2])
        }
        want = {
            frozenset((a[2], b[2])) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and a[3] != b[3]
        }
        assert want <= met


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", "y"), (2, "a b c d e f", "x", "z")], "doc_id LONG, text STRING, `__id` STRING, `__kept` STRING")
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "a b c d e f", "x", "y")]
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs.withColumnRenamed("doc_id", "class_id"), id="class_id")
