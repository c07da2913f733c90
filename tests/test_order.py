"""Positions, frames and running values against plain Python, on split and whole groups."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stridemill.operators import order
from stridemill.operators.windows import SliceGrid, assign_slices, lookahead_samples, slice_summary, sliding_windows

LIMITS = [None, 50, 2]  # no group is hot, some are, almost all are


@pytest.fixture(autouse=True)
def many_hot_keys(monkeypatch):
    monkeypatch.setattr(order, "HOT_KEYS", 1000)


def series(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["t"]):
        out[r["k"]].append(r["v"])
    return out


def test_split_hot_bounds_the_number_of_hot_keys(skewed, monkeypatch):
    monkeypatch.setattr(order, "HOT_KEYS", 4)  # 354 rows: only groups above 89 rows may be hot
    cold, hot = order.split_hot(skewed, "k", 1)
    assert {r["k"] for r in hot.select("k").distinct().collect()} == {0, 6}
    assert cold.count() + hot.count() == skewed.count()


def test_split_hot_without_hot_keys(skewed):
    cold, hot = order.split_hot(skewed, "k")
    assert hot is None and cold is skewed


def test_null_key_is_a_group_of_its_own(skewed):
    cold, hot = order.split_hot(skewed, "k", 25)
    assert hot.where("k IS NULL").count() == 30
    assert cold.where("k IS NULL").count() == 0


def test_global_position_is_the_sorted_index(spark):
    values = [(i * 7919) % 1009 for i in range(1009)]
    df = spark.createDataFrame([(v,) for v in values], "v INT").repartition(5)
    ranked = order.rank_globally(df, "v")
    assert ranked.total == 1009
    assert all(r["pos"] == r["v"] for r in ranked.df.collect())


def test_global_position_of_nothing(spark):
    ranked = order.rank_globally(spark.createDataFrame([], "v INT"), "v")
    assert ranked.total == 0 and ranked.df.count() == 0


@pytest.mark.parametrize("limit", LIMITS)
def test_keyed_position(skewed, limit):
    out = order.with_position(skewed, "t", "k", total="n", max_group_rows=limit).collect()
    sizes = {k: len(v) for k, v in series(skewed).items()}
    assert len(out) == sum(sizes.values())
    assert all(r["pos"] == r["t"] and r["n"] == sizes[r["k"]] for r in out)


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("length,ahead,chunk", [(1, 0, 4), (1, 1, 3), (4, 1, 5), (4, 3, 7), (60, 2, 61)])
def test_lookahead(skewed, limit, length, ahead, chunk):
    out = lookahead_samples(skewed, "v", length, ahead, "t", "k", max_group_rows=limit, chunk_rows=chunk)
    got = sorted((str(r["k"]), r["pos"], r["x"], r["target"]) for r in out.collect())
    want = sorted(
        (str(k), i, v[i : i + length], v[i + length + ahead - 1])
        for k, v in series(skewed).items()
        for i in range(len(v) - length - ahead + 1)
    )
    assert got == want  # NULLs inside x and as target are kept


def test_lookahead_unkeyed_series_with_counts(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(144)], "pos0 INT, v DOUBLE")
    cut = df.withColumn("split", F.when(F.col("pos0") < 108, "train").otherwise("test"))
    out = lookahead_samples(cut, "v", 4, 1, "pos0", "split").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"train": 104, "test": 32}
    whole = lookahead_samples(df, "v", 4, 1, "pos0", chunk_rows=10).collect()
    assert len(whole) == 140
    assert all(r["x"] == [r["pos"] + i for i in range(4)] and r["target"] == r["pos"] + 4 for r in whole)


def test_series_shorter_than_the_window(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(3)], "t INT, v DOUBLE")
    assert lookahead_samples(df, "v", 3, 1, "t").count() == 0
    assert lookahead_samples(df, "v", 2, 1, "t").count() == 1


def ramp(spark):
    rows = [tuple([t] + [10 * t + j for j in range(10)]) for t in range(20)]
    return spark.createDataFrame(rows, "ts INT, " + ", ".join(f"c{j} INT" for j in range(10)))


def test_slide_golden(spark):
    out = sliding_windows(ramp(spark), [f"c{j}" for j in range(9)], "c9", 5, 5, "ts").orderBy("start").collect()
    assert [r["label"] for r in out] == [49, 99, 149, 199]
    assert [r["ts"] for r in out] == [4, 9, 14, 19]
    assert out[1]["x"] == [[float(10 * t + j) for j in range(9)] for t in range(5, 10)]


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("window,stride", [(5, 1), (5, 2), (12, 2), (6, 3), (3, 5), (50, 1), (51, 20)])
def test_sliding_windows(skewed, limit, window, stride):
    out = sliding_windows(
        skewed, ["t", "v"], "t", window, stride, "t", partition_by="k", max_group_rows=limit, chunk_rows=13
    )
    got = sorted((str(r["k"]), r["start"], r["x"], r["label"], r["ts"]) for r in out.collect())
    want = sorted(
        (
            str(k), i, [[float(t), v[t]] for t in range(i, i + window)], i + window - 1, i + window - 1,
        )
        for k, v in series(skewed).items()
        for i in range(0, len(v) - window + 1, stride)
    )
    assert got == want


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("inclusive", [True, False])
def test_running(skewed, limit, inclusive):
    out = order.running(
        skewed,
        {"s": ("sum", "v"), "c": ("count", "v"), "hi": ("max", "v"), "lo": ("min", "v")},
        "t", "k", inclusive, max_group_rows=limit, chunk_rows=7,
    )
    by_key = series(skewed)
    rows = out.collect()
    assert len(rows) == sum(map(len, by_key.values()))
    for r in rows:
        seen = [x for x in by_key[r["k"]][: r["t"] + inclusive] if x is not None]
        assert r["c"] == len(seen)
        assert (r["s"], r["hi"], r["lo"]) == ((sum(seen), max(seen), min(seen)) if seen else (None, None, None))


def test_running_unkeyed(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(100)], "t INT, v DOUBLE")
    out = order.running(df, {"s": ("sum", "v")}, "t", chunk_rows=9).collect()
    assert all(r["s"] == sum(i % 5 for i in range(r["t"] + 1)) for r in out)


def test_known_hot_keys_are_not_counted_again(skewed, monkeypatch):
    hot = order.hot_keys(skewed, "k", 50)
    monkeypatch.setattr(order, "hot_keys", None)
    cold, rest = order.split_hot(skewed, "k", 50, hot)
    assert {r["k"] for r in rest.select("k").distinct().collect()} == {0, 2, 6}
    assert cold.count() + rest.count() == skewed.count()


def test_range_partitions_follow_the_size(spark, monkeypatch):
    monkeypatch.setattr(order, "RANGE_BYTES", 4000)
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    ranked = order.rank_globally(df, "v")
    assert ranked.total == 5000 and all(r["pos"] == r["v"] for r in ranked.df.collect())
    assert order.range_partitions(df) == 10


def test_positional_join_trims_to_the_shorter(spark):
    a = spark.createDataFrame([(i * 3,) for i in range(10)], "a INT")
    b = spark.createDataFrame([(i * 5,) for i in range(7)], "b INT")
    out = order.positional_join(a, b, "a", "b").collect()
    assert sorted((r["pos"], r["a"], r["b"]) for r in out) == [(i, 3 * i, 5 * i) for i in range(7)]
    with pytest.raises(ValueError):
        order.positional_join(a, a, "a", "a")


@pytest.mark.parametrize("length,stride", [(10, 10), (10, 4), (4, 10), (7, 3)])
def test_slices_against_brute_force(spark, length, stride):
    times = sorted({(i * i * 7) % 211 + 5 for i in range(60)})
    df = spark.createDataFrame([(t, float(t)) for t in times], "t INT, v DOUBLE")
    grid = SliceGrid.fit(df, "t", length, stride)
    starts = []
    s = times[0]
    while s < times[-1] - length + stride:
        starts.append(s)
        s += stride
    assert grid.count == len(starts)
    want = {k: [t for t in times if s <= t < s + length] for k, s in enumerate(starts)}
    want = {k: v for k, v in want.items() if v}
    members = assign_slices(df, "t", grid).groupBy("slice").agg(F.sort_array(F.collect_list("t")).alias("t"))
    assert {r["slice"]: r["t"] for r in members.collect()} == want
    summary = {r["slice"]: (r["n"], r["total"], r["low"], r["high"]) for r in slice_summary(df, "t", "v", grid).collect()}
    assert summary == {k: (len(v), sum(v), min(v), max(v)) for k, v in want.items()}


def test_slices_of_nothing(spark):
    df = spark.createDataFrame([], "t INT, v DOUBLE")
    assert assign_slices(df, "t", SliceGrid.fit(df, "t", 5)).count() == 0


def test_bad_arguments(skewed):
    with pytest.raises(ValueError):
        lookahead_samples(skewed, "nope", 2, 1, "t")
    with pytest.raises(ValueError):
        lookahead_samples(skewed, "v", 0, 1, "t")
    with pytest.raises(ValueError):
        sliding_windows(skewed, ["v"], "t", 3, 0, "t")
    with pytest.raises(ValueError):
        SliceGrid.fit(skewed, "t", 0)


def test_chunks_of_wide_rows_keep_their_size():
    for width in (8, 800, 80_000, 8_000_000):
        for reach in (0, 3, 50, 5000):
            rows = order.array_rows(reach, width)
            assert rows >= max(1, reach)
            assert rows <= max(1, reach) or rows * width <= order.ARRAY_BYTES
    assert order.array_rows(49, 8 * 10_000) == 16 * 2**20 // 80_000 and order.array_rows(3, 16) == order.ARRAY_ROWS


@pytest.mark.parametrize("limit", [16 << 20, 200])
def test_wide_windows_do_not_depend_on_the_chunks(spark, limit, monkeypatch):
    monkeypatch.setattr(order, "ARRAY_BYTES", limit)
    columns = [f"f{i}" for i in range(12)]
    rows = [(t, *[float(t * 31 % 17 + i) for i in range(12)]) for t in range(90)]
    df = spark.createDataFrame(rows, "t INT, " + ", ".join(f"{c} DOUBLE" for c in columns))
    out = sliding_windows(df, columns, "t", 7, 3, order_by="t").orderBy("start").collect()
    assert [r["start"] for r in out] == list(range(0, 84, 3))
    assert all([list(x) for x in r["x"]] == [list(rows[r["start"] + k][1:]) for k in range(7)] for r in out)
