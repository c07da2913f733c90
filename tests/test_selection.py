"""Exact splits against a sort in Python: ties, repeated rows, nulls, all types, several rounds of refinement."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stridemill.operators import sampling, selection, splits


@pytest.fixture(params=[200_000, 3])
def counted(request, monkeypatch):
    """With the usual limits, and with limits that force many rounds."""
    monkeypatch.setattr(selection, "COUNTED_ROWS", request.param)
    monkeypatch.setattr(selection, "SAMPLE_ROWS", 20_000 if request.param > 3 else 12)


def _key(*values):
    return tuple((v is not None, v) if v is not None else (False,) for v in values)


def _check(frame, rows, n, names):
    """The multiset of training rows is that of the first ``n`` rows in full order."""
    got = Counter(tuple(r[c] for c in names) for r in frame.where("split = 'train'").collect())
    rest = Counter(tuple(r[c] for c in names) for r in frame.where("split = 'test'").collect())
    want = sorted(rows, key=lambda r: _key(*r))
    assert got == Counter(want[:n]) and rest == Counter(want[n:])


@pytest.mark.parametrize("ratio", [0, 0.1, 0.5, 1])
def test_ties_at_every_place(spark, counted, ratio):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 1, 1, 2, 5]), rng.choice(["a", "b", None]), rng.randint(0, 2)) for _ in range(120)]
    df = spark.createDataFrame(rows, "a INT, b STRING, c INT")
    _check(splits.ordered_split(df, ratio, "a"), rows, int(ratio * 120), ["a", "b", "c"])


def test_two_tied_pairs(spark):
    rows = [(1, "x"), (1, "y"), (2, "x"), (2, "y")]
    df = spark.createDataFrame(rows, "k INT, v STRING")
    for n in range(6):
        _check(splits.fixed_split(df, n, "k"), rows, min(n, 4), ["k", "v"])
    out = splits.ordered_split(df, 0.25, "k").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"train": 1, "test": 3}


def test_one_key_holds_most_rows(spark, counted):
    rows = [(7, i % 5) for i in range(300)] + [(i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "k INT, v INT")
    for n in (12, 150, 307, 330):
        _check(splits.fixed_split(df, n, "k"), rows, n, ["k", "v"])


def test_random_split_of_repeated_ids(spark, counted):
    rows = [(i % 9, i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "id INT, v INT")
    for ratio in (0.05, 0.5):
        out = sampling.random_split(df, ratio, "id", seed=3)
        assert out.where("split = 'train'").count() == int(ratio * 90)
        assert Counter((r["id"], r["v"]) for r in out.collect()) == Counter(rows)
        mixed = out.groupBy("id").agg(F.countDistinct("split").alias("n")).where("n > 1").count()
        assert mixed <= 1  # only the ids at the cut are divided


def test_all_types_and_odd_values(spark, counted):
    rows = spark.range(60).selectExpr(
        "CAST(id % 3 AS INT) AS k",
        "timestamp_seconds(id % 4) AS t",
        "CAST(id % 5 AS DECIMAL(9,2)) AS d",
        "CASE id % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN 0.0D WHEN 2 THEN -0.0D END AS x",
        "map('b', id % 2, 'a', 1L) AS m",
        "array(id % 2) AS l",
        "CAST(CAST(id % 7 AS STRING) AS BINARY) AS raw",
        "struct(id % 2 AS p, CAST(NULL AS DATE) AS q) AS s",
    )
    for n in (0, 20, 41):
        out = splits.fixed_split(rows, n, "k")
        assert out.where("split = 'train'").count() == n
        again = out.drop("split").selectExpr("*", "CAST(x AS STRING) AS sign")
        whole = rows.selectExpr("*", "CAST(x AS STRING) AS sign")
        assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))


def test_empty_table(spark):
    df = spark.createDataFrame([], "k INT")
    assert splits.ordered_split(df, 0.5, "k").count() == 0
    assert sampling.random_split(df, 0.5, "k").count() == 0
    assert splits.fixed_split(df, 4, "k").columns == ["k", "split"]


def test_rows_are_not_sorted_or_moved(spark, counted):
    df = spark.range(2000).selectExpr("id % 40 AS k", "id")
    out = splits.ordered_split(df, 0.3, "k")
    assert out.where("split = 'train'").count() == 600
    main = out._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in main and "rangepartitioning" not in main


def test_a_round_shrinks_the_range_by_far(spark, monkeypatch):
    """100,000 rows and room for 1,000: two rounds at most read them."""
    monkeypatch.setattr(selection, "COUNTED_ROWS", 1000)
    monkeypatch.setattr(selection, "SAMPLE_ROWS", 5000)
    seen, real = [], selection._borders
    monkeypatch.setattr(selection, "_borders", lambda keys, rows, rank: seen.append(rows) or real(keys, rows, rank))
    df = spark.range(100_000).select(F.xxhash64("id").alias("k"))
    cut = selection.find_cut(df.select(F.struct("k").alias("k")), 61_234, 100_000)
    assert cut.key.first()["k"]["k"] == sorted(r["k"] for r in df.collect())[61_234]
    assert (cut.ties, cut.before) == (1, 0) and len(seen) <= 3 and seen[1:] == sorted(seen[1:], reverse=True)
    assert all(b < a / 8 for a, b in zip(seen, seen[1:]))
