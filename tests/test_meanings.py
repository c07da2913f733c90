"""Inputs on which an operator could easily give a wrong or an arbitrary result."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from stridemill.functions import metrics
from stridemill.functions.scalars import row_hash
from stridemill.operators import order, runlog, running, sampling, splits, windows
from stridemill.sources import idx


def test_user_metrics_may_use_the_same_state_names(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0)], "prediction DOUBLE, target DOUBLE")

    def mean_of(name, value):
        return metrics.Metric(
            name, lambda p, t: {"total": F.sum(value(p, t)), "rows": F.count(F.lit(1))},
            lambda s: F.try_divide(s["total"], s["rows"]),
        )

    both = [mean_of("a", lambda p, t: p), mean_of("b", lambda p, t: p * 10), "mse", "rmse"]
    row = metrics.evaluate(df, both).first()
    assert (row["a"], row["b"], row["mse"]) == (1.5, 15.0, 2.5)
    merged = metrics.finish_states(metrics.merge_states(metrics.partial_states(df, both), both), both).first()
    assert merged == row
    with pytest.raises(ValueError):
        metrics.evaluate(df, ["mse", metrics.mse()])


def test_merged_r2_keeps_its_digits(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=2000)
    y = x + rng.normal(size=2000)
    rows = [(int(i % 4), float(1e9 + a), float(1e9 + b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "part INT, prediction DOUBLE, target DOUBLE")
    want = metrics.evaluate(df, ["r2"]).first()["r2"]
    parts = metrics.partial_states(df, ["r2"], by="part")
    got = metrics.finish_states(metrics.merge_states(parts, ["r2"]), ["r2"]).first()["r2"]
    assert got == pytest.approx(want, rel=1e-6)
    keyed = parts.withColumn("k", F.lit(1))
    again = metrics.merge_states(metrics.merge_states(keyed.withColumn("h", F.col("part") % 2), ["r2"], ["k", "h"]), ["r2"], "k")
    assert metrics.finish_states(again, ["r2"]).first()["r2"] == pytest.approx(want, rel=1e-6)


def test_row_hash_tells_ids_apart(spark):
    rows = [(None, "a"), ("a", None), ("x:y", "z"), ("x", "y:z"), ("\\N", "a"), ("x\\", "y:z"), ("x\\:y", "z"), ("", "a")]
    df = spark.createDataFrame(rows, "a STRING, b STRING").select(row_hash(["a", "b"], 1).alias("h"))
    assert df.distinct().count() == len(rows)


def test_random_split_is_exact_on_any_ids(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("x:y", "z"), ("x", "y:z")], "a STRING, b STRING")
    got = sampling.random_split(df, 0.5, ["a", "b"]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 2, "test": 2}
    same = spark.range(10).select(F.lit(1).alias("id"))
    for ratio, train in ((0, 0), (0.25, 2), (0.5, 5), (0.99, 9), (1, 10)):
        got = sampling.random_split(same, ratio, "id").groupBy("split").count().collect()
        assert {r["split"]: r["count"] for r in got} == {k: n for k, n in (("train", train), ("test", 10 - train)) if n}


@pytest.mark.parametrize("trigger, epoch", [("increase", 3), ("decrease", 1)])
def test_nan_is_no_best_epoch(spark, trigger, epoch):
    df = spark.createDataFrame([("r", 1, 0.5), ("r", 2, float("nan")), ("r", 3, 0.9)], "run STRING, epoch INT, m DOUBLE")
    assert running.best_epoch(df, "m", trigger=trigger).first()["epoch"] == epoch


def test_slices_on_fractional_times(spark):
    grid = windows.SliceGrid(0.0, 0.3, 0.1, 60)
    times = [0.7, 0.1 * 3, 0.30000000000000004, 2.9, 0.0] + [k / 10 for k in range(60)]
    df = spark.createDataFrame([(float(t),) for t in times], "t DOUBLE")
    got = sorted((r["t"], r["slice"]) for r in windows.assign_slices(df, "t", grid).collect())
    want = sorted((t, k) for t in times for k in range(60) if 0.0 + k * 0.1 <= t < 0.0 + k * 0.1 + 0.3)
    assert got == want


def test_wide_metrics_follow_what_was_logged(spark):
    schema = "phase STRING, epoch INT, metric STRING, value DOUBLE, ts INT"
    df = spark.createDataFrame([("t", 1, "acc", 0.1, 1), ("t", 1, "acc", 0.7, 3), ("t", 1, "acc", 0.4, 2), ("t", 2, "acc", None, 4)], schema)
    got = {r["epoch"]: r["acc"] for r in runlog.metrics_wide(df, ["acc"]).collect()}
    assert got == {1: 0.7, 2: None}
    with pytest.raises(SparkRuntimeException):
        runlog.metrics_wide(df.withColumn("metric", F.lit("loss")), ["acc"]).collect()
    with pytest.raises(SparkRuntimeException):
        runlog.metrics_wide(df.drop("ts"), ["acc"]).collect()


@pytest.mark.parametrize("operator", [
    lambda df: running.progress(df, "t", "t", "k"),
    lambda df: running.column_max_normalise(df, "v", "k"),
    lambda df: order.with_position(df, "t", "k"),
], ids=["progress", "column_max", "position"])
def test_hot_keys_read_the_input_twice_at_most(spark, skewed, operator, monkeypatch):
    monkeypatch.setattr(order, "GROUP_ROWS", 50)
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    counted = skewed.coalesce(2).mapInArrow(count, skewed.schema)
    operator(counted).write.format("noop").mode("overwrite").save()
    assert reads.value <= 2 * skewed.count()


def test_padding_moves_the_arrays_once(spark):
    df = spark.range(100).select(F.col("id"), F.sequence(F.lit(1), F.col("id") % 7 + 1).cast("array<double>").alias("x"))
    got = splits.padded_batches(df, "x", "id", 16).collect()
    assert len(got) == 100
    for r in got:
        length = r["id"] % 7 + 1
        batch = range(r["batch_ix"] * 16, min(100, r["batch_ix"] * 16 + 16))
        assert r["pos"] == r["id"] and r["len"] == length
        assert r["x"] == [float(k) for k in range(1, length + 1)] + [0.0] * (max(i % 7 + 1 for i in batch) - length)


def test_ordered_batches(spark):
    df = spark.range(10).select((9 - F.col("id")).alias("t"), (F.col("id") * 2).alias("p"))
    got = splits.ordered_batches(df, "t", 4, ["t", "p"]).orderBy("batch_ix").collect()
    assert [(r["t"], r["p"]) for r in got] == [
        ([0, 1, 2, 3], [18, 16, 14, 12]), ([4, 5, 6, 7], [10, 8, 6, 4]), ([8, 9], [2, 0])
    ]


def test_labelled_images_cut_differently(spark, tmp_path):
    rng = np.random.default_rng(0)
    images, labels = rng.integers(0, 256, (30, 2, 3)), rng.integers(0, 10, 30)
    for kind, values, cuts in (("images", images, (0, 7, 7, 19, 30)), ("labels", labels, (0, 3, 25, 30))):
        (tmp_path / kind).mkdir()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            (tmp_path / kind / f"part-{k}").write_bytes(idx.idx_bytes(values[a:b].reshape(b - a, 2, 3) if kind == "images" else values[a:b]))
    df = idx.read_labelled_images(spark, str(tmp_path / "images"), str(tmp_path / "labels"), 30)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, df.collect()))
    assert got == [(k, images[k].tolist(), int(labels[k])) for k in range(30)]
    raw = {"train": (str(tmp_path / "images"), str(tmp_path / "labels"))}
    copy = f"{tmp_path}/copy"
    assert idx.convert_once(spark, raw, copy).count() == 30
    (tmp_path / "copy" / "_SUCCESS").unlink()  # as a broken-off write leaves it
    (next((tmp_path / "copy" / "split=train").glob("*.parquet"))).unlink()
    assert idx.convert_once(spark, raw, copy).count() == 30
