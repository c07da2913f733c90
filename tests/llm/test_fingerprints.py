"""Fingerprints against closed syncmers, sketches and likeness worked out in Python."""

from __future__ import annotations

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from stridemill.llm import fingerprints as fp
from stridemill.llm import queries


def _hash(data: bytes) -> int:
    value = xxhash.xxh64_intdigest(data, seed=42)
    return value - (1 << 64) if value >> 63 else value


def _anchors(text, inner=fp.INNER, window=fp.WINDOW):
    data = (text or "").encode()
    s = [_hash(data[i : i + inner]) for i in range(len(data) - inner + 1)]
    k, out = inner + window - 1, []
    for i in range(len(data) - k + 1):
        part = s[i : i + window]
        if min(part) in (part[0], part[-1]):
            out.append((_hash(data[i : i + k]) & ((1 << 48) - 1), i))
    return out


def _sketch(text, size=fp.SIZE, **shape):
    first = {}
    for h, i in _anchors(text, **shape):
        first.setdefault(h, i)
    first = first or {_hash((text or "").encode()) & ((1 << 48) - 1): 0}
    return dict(sorted(first.items())[:size])


def _likeness(a, b, size=fp.SIZE):
    union = sorted(a.keys() | b.keys())[:size]
    shifts = [b[h] - a[h] for h in union if h in a and h in b]
    return sum(x == 0 or shifts.count(x) > 1 for x in shifts) / len(union)


def _spelled(sketch):
    return " ".join(f"{h:012x}@{i}" for h, i in sketch.items())


def _expected(rows, **shape):
    """(id, text) rows in descending order of id, each with the next."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).digest()))
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, behind = (_sketch(t, **shape) for t in (text, edited, after))
        out.append((i, len(text), edited, _spelled(own), _spelled(other), _likeness(own, other), _likeness(own, behind)))
    return sorted(out, key=repr)


def _found(frame):
    cols = ["n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted([(r["doc_id"], *(r[c] for c in cols)) for r in frame.collect()], key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdéfgh", k=rng.randint(1, 9))) for _ in range(300)]
    return [" ".join(rng.choices(words, k=n)) for n in (0, 1, 3, 40, 41, 200, 1500, 3000, 90, 70, 60, 50)]


def test_compare_with_next(spark, texts):
    rows = [(3 * i % 13, t) for i, t in enumerate(texts)] + [(50, texts[5]), (51, texts[5] + " and more"), (52, None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    for chunk in (1, 2, 5, 250_000):
        assert _found(fp.compare_with_next(docs, chunk_rows=chunk)) == _expected(rows)


def test_other_sizes(spark, texts):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    shape = {"inner": 5, "window": 13}
    out = docs.select("doc_id", fp.sketch("text", size=9, **shape).alias("s"), fp.anchors("text", **shape).alias("a"))
    for row in out.collect():
        text = rows[row["doc_id"]][1]
        assert [(x["h"], x["pos"]) for x in row["a"]] == _anchors(text, **shape)
        assert dict(zip(row["s"]["h"], row["s"]["pos"])) == _sketch(text, 9, **shape)


def test_repeated_rows_nulls_and_ties(spark, monkeypatch):
    monkeypatch.setattr(fp, "COPIES", 3)
    long = "one two three four five six seven eight nine ten " * 3
    rows = [(7, "a" * 90)] * 8 + [(7, long), (None, None), (None, "x"), (None, "x"), (8, ""), (8, None), (-(2**63), "q" * 40)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert _found(fp.compare_with_next(docs)) == _expected(rows)


def test_one_row_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "only " * 20)], "doc_id LONG, text STRING")
    assert _found(fp.compare_with_next(docs)) == _expected([(1, "only " * 20)])
    assert _found(fp.compare_with_next(docs.limit(0))) == []


def test_very_long_text_in_pieces(spark):
    rng = random.Random(9)
    text = " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(30_000))
    docs = spark.createDataFrame([(1, text), (2, text[100:] + "!")], "doc_id LONG, text STRING")
    made = {r["doc_id"]: dict(zip(r["s"]["h"], r["s"]["pos"])) for r in docs.select("doc_id", fp.sketch("text").alias("s")).collect()}
    assert made[1] == _sketch(text)
    near = docs.where("doc_id = 1").select(fp.sketch("text").alias("a")).crossJoin(
        docs.where("doc_id = 2").select(fp.sketch("text").alias("b"))
    ).select(fp.likeness("a", "b")).first()[0]
    assert near == _likeness(made[1], made[2]) > 0.9


def test_likeness_counts_aligned_anchors_only():
    same = {1: 10, 2: 20, 3: 30}
    assert _likeness(same, {1: 15, 2: 25, 3: 30}) == 1
    assert _likeness(same, {1: 15, 2: 90, 3: 300}) == 0


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 2)], "id LONG, text STRING, none STRING, made INT")
    assert fp.compare_with_next(docs, id="id").columns[0] == "id"
    assert fp.fingerprints(docs, id="made").columns == ["made", "n_chars", "fingerprint"]
    with pytest.raises(ValueError):
        fp.compare_with_next(docs.withColumnRenamed("id", "edited"), id="edited")


def test_query_is_native_and_right(spark, data):
    out = queries.QUERIES["op11_fingerprints"](spark, data)
    plan = out._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    expected = [(r[0], r[1], hashlib.sha256(r[2].encode()).hexdigest(), *r[3:]) for r in _expected(rows)]
    cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(tuple(r[c] for c in cols) for r in out.collect()) == sorted(expected)


def test_texts_move_twice_at_most(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    frame = fp.compare_with_next(docs).where(F.col("near_next") >= 0)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan or "ReusedQueryStage" in plan or plan.count("partial_max") <= 3
