"""Sampling, splits, labels, scaling, evaluation and run logs."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stridemill.functions.scalars import row_hash
from stridemill.operators import (
    evaluation, joins, labels, order, runlog, running, sampling, scaling, splits, transforms,
)


@pytest.fixture
def ids(spark):
    return spark.createDataFrame([(i, i % 7, float(i * i % 53)) for i in range(311)], "id INT, g INT, v DOUBLE").repartition(5)


# --- sampling and splits --------------------------------------------------------


def hash_ranks(n, *salt):
    def digest(i):
        return hashlib.md5(":".join(map(str, (i, *salt))).encode()).hexdigest()

    return {i: rank for rank, i in enumerate(sorted(range(n), key=digest))}


def test_hash_position_is_the_rank_of_the_digest(ids):
    want = hash_ranks(311, 4)
    out = sampling.hash_position(ids, "id", 4, total="n").collect()
    assert all(r["pos"] == want[r["id"]] and r["n"] == 311 for r in out)


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_random_split_is_exact_and_disjoint(ids, ratio):
    out = {r["id"]: r["split"] for r in sampling.random_split(ids, ratio, "id", 9).collect()}
    want = hash_ranks(311, 9)
    assert len(out) == 311
    assert all((out[i] == "train") == (want[i] < int(ratio * 311)) for i in out)


def test_random_split_checks_the_ratio(ids):
    with pytest.raises(ValueError):
        sampling.random_split(ids, 1.5, "id")


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_sample_with_replacement(ids, n):
    out = sampling.sample_with_replacement(ids, n, "id", seed=2)
    rows = out.collect()
    assert sorted(r["draw"] for r in rows) == list(range(n))
    by_rank = {rank: i for i, rank in hash_ranks(311, 2).items()}
    for r in rows:
        digest = hashlib.md5(f"{r['draw']}:2".encode()).hexdigest()
        assert r["id"] == by_rank[int(digest[:15], 16) % 311]


def test_sample_from_nothing(spark):
    none = spark.createDataFrame([], "id INT")
    assert sampling.sample_with_replacement(none, 0, "id").count() == 0
    with pytest.raises(ValueError):
        sampling.sample_with_replacement(none, 1, "id")


def test_sample_from_one_row(spark):
    one = spark.createDataFrame([(8,)], "id INT")
    assert sampling.sample_with_replacement(one, 5, "id").count() == 5


def test_first_n(ids):
    assert [r["id"] for r in sampling.first_n(ids, 3, "id").collect()] == [0, 1, 2]
    assert sampling.first_n(ids, 1000, "id").count() == 311


def test_take_positions_keeps_order_and_repeats(spark, ids):
    index = spark.createDataFrame([(0, 5), (1, 2), (2, 5), (3, 900)], "ord INT, pos LONG")
    out = sampling.take_positions(ids, index, "id").orderBy("ord").collect()
    assert [(r["ord"], r["id"]) for r in out] == [(0, 5), (1, 2), (2, 5)]


def test_concat_sources(spark):
    a = spark.createDataFrame([(2,), (1,)], "x INT")
    b = spark.createDataFrame([(1,), (0,)], "x INT")
    out = sampling.concat_sources([a, b], "x").orderBy("pos").collect()
    assert [(r["loader_ix"], r["x"], r["pos"]) for r in out] == [(0, 1, 0), (0, 2, 1), (1, 0, 2), (1, 1, 3)]
    with pytest.raises(ValueError):
        sampling.concat_sources([], "x")


@pytest.mark.parametrize("ratio", [0.0, 0.3, 1.0])
def test_ordered_split(ids, ratio):
    out = splits.ordered_split(ids, ratio, "id").collect()
    assert all((r["split"] == "train") == (r["id"] < int(ratio * 311)) for r in out)


@pytest.mark.parametrize("limit", [None, 10])
def test_ordered_split_per_series(ids, limit, monkeypatch):
    monkeypatch.setattr(order, "HOT_KEYS", 1000)
    out = splits.ordered_split(ids, 0.5, "id", "g", max_group_rows=limit).groupBy("g").agg(
        F.count("*").alias("n"), F.sum((F.col("split") == "train").cast("int")).alias("train")
    )
    assert all(r["train"] == int(0.5 * r["n"]) for r in out.collect())


def test_ordered_split_with_null_order_values(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 3), (4, 4)], "a INT, b INT")
    out = {r["b"]: r["split"] for r in splits.ordered_split(df, 0.5, ["a", "b"]).collect()}
    assert out == {1: "train", 2: "train", 3: "test", 4: "test"}


def test_fixed_split(ids):
    out = splits.fixed_split(ids, 108, "id")
    assert out.where("split = 'train'").agg(F.max("id")).first()[0] == 107
    assert splits.fixed_split(ids, 1000, "id").where("split = 'test'").count() == 0


@pytest.mark.parametrize("drop", [False, True])
def test_batches(ids, drop):
    out = splits.batches(ids, "id", 16, drop_last=drop).collect()
    assert len(out) == (304 if drop else 311)
    assert all(r["batch_ix"] == r["id"] // 16 for r in out)


def test_shuffled_batches_differ_per_epoch(ids):
    def of(epoch):
        rows = splits.shuffled_batches(ids, "id", 16, seed=1, epoch=epoch, drop_last=True).collect()
        sizes = pd.Series([r["batch_ix"] for r in rows]).value_counts()
        assert set(sizes) == {16}
        return {r["id"]: r["pos"] for r in rows}

    assert of(0) != of(1)
    assert of(1) == of(1)


def test_pad_batches(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0]), (None, [6.0])], "batch_ix INT, x ARRAY<DOUBLE>")
    out = sorted((str(r["batch_ix"]), r["len"], r["x"]) for r in splits.pad_batches(df, "x").collect())
    assert out == [("0", 1, [1, 0, 0]), ("0", 3, [1, 2, 3]), ("1", 2, [4, 5]), ("None", 1, [6])]


# --- labels and scaling ---------------------------------------------------------


@pytest.fixture
def labelled(spark):
    rows = [("train", "b", 3.0), ("train", "a", 2.0), ("train", "b", 5.0), ("test", "a", 1.0), ("test", "b", 9.0)]
    return spark.createDataFrame(rows, "split STRING, label STRING, y DOUBLE")


def test_class_mapping(labelled, spark):
    out = labels.encode_classes(labelled, "label").select("label", "class_id").distinct().collect()
    assert {r["label"]: r["class_id"] for r in out} == {"a": 0, "b": 1}
    unseen = labelled.unionByName(spark.createDataFrame([("test", "z", 0.0)], labelled.schema))
    with pytest.raises(Exception, match="unseen label: z"):
        labels.encode_classes(unseen, "label").collect()
    kept = labels.encode_classes(unseen, "label", handle_unseen="null")
    assert kept.where("class_id IS NULL").count() == 1 and kept.count() == 6


def test_many_classes_are_numbered_without_one_task(labelled, monkeypatch):
    monkeypatch.setattr(labels, "SMALL_CLASSES", 1)
    out = labels.encode_classes(labelled, "label").select("label", "class_id").distinct().collect()
    assert {r["label"]: r["class_id"] for r in out} == {"a": 0, "b": 1}


def test_zero_base(labelled):
    out = sorted(r["y"] for r in labels.zero_base_labels(labelled, "y").collect())
    assert out == [-1.0, 0.0, 1.0, 3.0, 7.0]  # the test minimum does not count
    with pytest.raises(ValueError):
        labels.zero_base_labels(labelled.where("split = 'test'"), "y")


def test_counts_and_samples(labelled):
    assert {r["label"]: r["n"] for r in labels.class_counts(labelled, "label").collect()} == {"a": 2, "b": 3}
    own = labels.as_samples(labelled, "y").first()
    assert own["data"] == own["target"]
    assert "target" in labels.as_samples(labelled, "y", "label").columns


def test_min_max(spark):
    df = spark.createDataFrame([(float(v), v < 5) for v in range(1, 11)], "x DOUBLE, train BOOLEAN")
    scaler = scaling.MinMax.fit(df, "x")
    out = df.select(scaler.transform("x").alias("s"), scaler.inverse(scaler.transform("x")).alias("b"), "x").collect()
    assert [r["s"] for r in out] == [(r["x"] - 1) / 9 for r in out]
    assert np.allclose([r["b"] for r in out], [r["x"] for r in out])
    assert scaling.MinMax.fit(df, "x", F.col("train")) == scaling.MinMax(1.0, 4.0)
    constant = scaling.MinMax.fit(df.where("x = 3"), "x")
    assert df.select(constant.transform("x").alias("s")).first()["s"] is None
    with pytest.raises(ValueError):
        scaling.MinMax.fit(df, "train")


def test_standard(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(3, 2, (40, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in a], "p DOUBLE, q DOUBLE")
    scaler = scaling.Standard.fit(df, ["p", "q"])
    out = df.select(scaler.transform("p").alias("p"), scaler.transform("q").alias("q"))
    z = (a - a.mean(0)) / a.std(0, ddof=1)
    assert np.allclose(out.toPandas().to_numpy(), z)
    back = out.select(scaler.inverse("p").alias("p"), scaler.inverse("q").alias("q"))
    assert np.allclose(back.toPandas().to_numpy(), a)
    single = scaling.Standard.fit(df.limit(1), ["p"])
    assert df.select(single.transform("p").alias("p")).first()["p"] is None


def test_standard_array(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(-1, 3, (30, 5))
    df = spark.createDataFrame([(list(map(float, r)),) for r in a], "x ARRAY<DOUBLE>")
    scaler = scaling.StandardArray.fit(df, "x")
    out = df.select(scaler.transform("x").alias("z")).select("z", scaler.inverse("z").alias("b"))
    assert np.allclose([r["z"] for r in out.collect()], (a - a.mean(0)) / a.std(0, ddof=1))
    assert np.allclose([r["b"] for r in out.collect()], a)
    single = scaling.StandardArray.fit(df.limit(1), "x")
    assert df.select(single.transform("x").alias("z")).first()["z"] == [None] * 5


def test_channel_normalise(spark):
    df = spark.createDataFrame([([255.0, 0.0],)], "x ARRAY<DOUBLE>")
    row = df.select(
        scaling.channel_normalise("x", [0.5, 0.25], [0.5, 0.5]).alias("n"),
        scaling.channel_denormalise_clip(F.lit([3.0, -0.1]), [0.5, 0.25], [0.5, 0.5]).alias("d"),
    ).first()
    assert np.allclose(row["n"], [1.0, -0.5]) and np.allclose(row["d"], [1.0, 0.2])


# --- evaluation -----------------------------------------------------------------


def images(seed, n, classes):
    rng = np.random.default_rng(seed)
    z = rng.normal(0, 2, (n, classes, 3, 5))
    return z, rng.integers(0, classes, (n, 3, 5))


def pixel_rows(spark, z, t):
    rows = [
        (s, h, w, [float(v) for v in z[s, :, h, w]], int(t[s, h, w]))
        for s in range(z.shape[0]) for h in range(3) for w in range(5)
    ]
    return spark.createDataFrame(rows, "sample INT, h INT, w INT, logits ARRAY<DOUBLE>, target INT")


def image_reference(z, t, alpha, gamma):
    e = np.exp(z - z.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    hot = np.eye(z.shape[1])[t].transpose(0, 3, 1, 2) + 1e-6
    dice = 1 - 2 * (p * hot).sum((1, 2, 3)) / ((p + hot).sum((1, 2, 3)) + 1e-8)
    q = p + 1e-8
    focal = (hot * -alpha * np.maximum(1 - q, 0) ** gamma * np.log(q)).sum(1).mean((1, 2))
    return dice, focal


def test_image_losses(spark):
    z, t = images(3, 4, 5)
    df = pixel_rows(spark, z, t)
    dice, focal = image_reference(z, t, 0.5, 2.0)
    got = [r["loss"] for r in evaluation.dice_loss(df, "sample", reduction="none").orderBy("sample").collect()]
    assert np.allclose(got, dice) and all(0 <= v <= 1 for v in got)
    got = [r["loss"] for r in evaluation.focal_loss(df, "sample", 0.5).orderBy("sample").collect()]
    assert np.allclose(got, focal)
    assert math.isclose(evaluation.dice_loss(df, "sample").first()["loss"], dice.mean())
    assert math.isclose(evaluation.focal_loss(df, "sample", 0.5, reduction="sum").first()["loss"], focal.sum())
    dice, focal = image_reference(z, t, 0.48, 1.1)
    mixed = evaluation.mixed_loss(df, "sample").first()["loss"]
    assert math.isclose(mixed, focal.mean() - math.log(dice.mean()))
    each = [r["loss"] for r in evaluation.mixed_loss(df, "sample", reduction="none").orderBy("sample").collect()]
    assert np.allclose(each, focal - np.log(dice))


def test_image_losses_check_their_input(spark):
    df = pixel_rows(spark, *images(0, 1, 2))
    with pytest.raises(ValueError):
        evaluation.dice_loss(df, "sample", reduction="median")
    with pytest.raises(ValueError):
        evaluation.dice_loss(df.withColumn("target", F.col("target").cast("double")), "sample")


def test_confusion(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (1, 1), (5, 0)], "t INT, p INT")
    out = evaluation.normalise_rows(evaluation.confusion_matrix(df, "t", "p", 3)).collect()
    cells = {(r["y_true"], r["y_pred"]): (r["n"], r["share"]) for r in out}
    assert len(cells) == 9
    assert cells[0, 1] == (2, 2 / 3) and cells[1, 1] == (1, 1.0) and cells[1, 0] == (0, 0.0)
    assert cells[2, 0] == (0, None)


def test_batch_and_epoch_losses(spark):
    rows = [("training", 1, 0, 0, 1.0), ("training", 1, 0, 0, 3.0), ("training", 1, 0, 1, 8.0)]
    df = spark.createDataFrame(rows, "phase STRING, epoch INT, loader_ix INT, batch_ix INT, loss DOUBLE")
    batches = evaluation.batch_loss(df)
    assert sorted((r["loss"], r["n"]) for r in batches.collect()) == [(2.0, 2), (8.0, 1)]
    assert evaluation.epoch_loss(df, weighting="element").first()["loss"] == 4.0
    assert evaluation.epoch_loss(df, weighting="batch").first()["loss"] == 5.0
    both = evaluation.epoch_means(batches).first()
    assert (both["element_loss"], both["batch_loss"]) == (4.0, 5.0)
    weighted = evaluation.weighted_epoch(batches.withColumn("hit", F.lit(1)), correct="hit").first()
    assert weighted["loss"] == 4.0 and math.isclose(weighted["accuracy"], 2 / 3)
    with pytest.raises(ValueError):
        evaluation.epoch_loss(df, weighting="median")


def test_joint_loss(spark):
    rng = np.random.default_rng(5)
    m, v, a, b = rng.normal(size=(4, 6, 3))
    df = spark.createDataFrame(
        [tuple([*map(float, r)] for r in rs) for rs in zip(m, v, a, b)],
        "mean ARRAY<DOUBLE>, logvar ARRAY<DOUBLE>, a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
    )
    kl = -0.5 * (1 + v - m**2 - np.exp(v)).mean()
    assert math.isclose(evaluation.kl_divergence(df).first()["kl"], kl)
    out = evaluation.joint_loss(df, "a", "b").first()
    assert math.isclose(out["loss"], kl + ((a - b) ** 2).sum())
    assert math.isclose(evaluation.joint_loss(df, "a", "b", reduction="mean").first()["loss"], kl + ((a - b) ** 2).mean())
    with pytest.raises(ValueError):
        evaluation.joint_loss(df, "a", "b", reduction="none")


def test_user_metric_over_small_batches(spark):
    df = spark.createDataFrame([(i % 3 if i % 5 else None, float(i), float(i * i % 11)) for i in range(100)], "g INT, prediction DOUBLE, target DOUBLE")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = evaluation.batch_metric(
            df, lambda p, t: {"worst": float((p - t).clip(lower=0).sum()), "n": len(p)}, ["worst", "n"],
            lambda s: s["worst"] / s["n"], by="g",
        ).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = {}
    for r in df.collect():
        want.setdefault(r["g"], []).append(max(r["prediction"] - r["target"], 0))
    assert {r["g"]: round(r["metric"], 9) for r in out} == {g: round(sum(v) / len(v), 9) for g, v in want.items()}


def test_criteria_and_transforms(spark):
    df = spark.createDataFrame([(1.0, 3.0)], "prediction DOUBLE, target DOUBLE")
    assert evaluation.apply_criterion(df, "squared_error").first()["loss"] == 4.0
    assert evaluation.apply_criterion(df, lambda o, t: F.abs(o - t)).first()["loss"] == 2.0
    with pytest.raises(ValueError):
        evaluation.apply_criterion(df, "hinge")
    out = transforms.apply_transforms(
        df, lambda s: s * 10, lambda c: c + 1, data="prediction", transform_type="double"
    ).first()
    assert (out["prediction"], out["target"]) == (10.0, 4.0)


# --- run logs -------------------------------------------------------------------


@pytest.fixture
def ties(spark):
    return spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.5), ("r", 3, 0.7), ("r", 4, 0.6)], "run STRING, epoch INT, m DOUBLE")


def flags(df):
    return [r["improved"] for r in df.orderBy("epoch").collect()]


@pytest.mark.parametrize("limit", [None, 1])
def test_running_best(ties, limit, monkeypatch):
    monkeypatch.setattr(order, "HOT_KEYS", 1000)
    split = {"max_group_rows": limit, "chunk_rows": 2}
    assert flags(running.running_best(ties, "m", **split)) == [True, False, True, False]
    assert flags(running.running_best(ties, "m", trigger="decrease", **split)) == [True, True, False, False]
    assert flags(running.running_best(ties, "m", trigger="decrease", strict=True, **split)) == [True, False, False, False]


def test_running_best_refuses_nan(spark, ties):
    nan = ties.unionByName(spark.createDataFrame([("r", 5, math.nan)], ties.schema))
    with pytest.raises(Exception, match="metric is NaN"):
        running.running_best(nan, "m").collect()
    with pytest.raises(ValueError):
        running.running_best(ties, "m", trigger="up")


def test_best_epoch_and_latest(ties, spark):
    assert running.best_epoch(ties, "m").first()["epoch"] == 3
    assert running.best_epoch(ties, "m", trigger="decrease").first()["epoch"] == 1
    assert running.latest_values(ties, "m", "epoch", "run").first()["m"] == 0.6
    names = spark.createDataFrame([("9",), ("best",), ("10",), ("10.tmp",)], "name STRING")
    assert running.latest_checkpoint(names).first()["epoch"] == 10
    assert running.latest_checkpoint(names.where("name = 'best'")).first()["epoch"] is None


def test_cumulative_ends_at_the_overall_metric(spark):
    df = spark.createDataFrame([(i, float(i * 3 % 7), i % 4 + 1) for i in range(50)], "b INT, sse DOUBLE, n INT")
    out = {r["b"]: r["cumulative"] for r in running.cumulative_metric(df, "sse", "n", "b", chunk_rows=8).collect()}
    total = df.agg(F.sum("sse") / F.sum("n")).first()[0]
    assert math.isclose(out[49], total) and out[0] == 0.0


def test_progress(spark):
    df = spark.createDataFrame([("a", 0, 16), ("a", 1, 16), ("a", 2, 8)], "phase STRING, b INT, n INT")
    out = running.progress(df, "n", "b", "phase").orderBy("b").collect()
    assert [(r["seen"], r["total"], r["percent"]) for r in out] == [(16, 40, 40.0), (32, 40, 80.0), (40, 40, 100.0)]


def test_column_max(spark):
    df = spark.createDataFrame([(0, 2.0), (0, 4.0), (1, 0.0), (None, 5.0)], "t INT, p DOUBLE")
    out = sorted(str((r["t"], r["p"])) for r in running.column_max_normalise(df, "p", "t").collect())
    assert out == ["(0, 0.5)", "(0, 1.0)", "(1, None)", "(None, 1.0)"]


def events(spark):
    rows = [("training", 1, "loss", 3.0), ("training", 2, "loss", 2.0), ("validation", 1, "loss", 4.0), ("training", 1, "acc", 0.5)]
    return spark.createDataFrame([("r", *r) for r in rows], "run STRING, phase STRING, epoch INT, metric STRING, value DOUBLE")


def test_wide_metrics_and_curves(spark):
    wide = runlog.metrics_wide(events(spark), ["loss", "acc", "never"])
    assert wide.columns == ["phase", "epoch", "loss", "acc", "never"]
    assert {(r["phase"], r["epoch"]): (r["loss"], r["acc"], r["never"]) for r in wide.collect()} == {
        ("training", 1): (3.0, 0.5, None), ("training", 2): (2.0, None, None), ("validation", 1): (4.0, None, None)
    }
    curve = joins.learning_curve(events(spark)).collect()
    assert [(r["epoch"], r["training"], r["validation"]) for r in curve] == [(1, 3.0, 4.0)]
    outer = joins.learning_curve(events(spark), how="full_outer").orderBy("epoch").collect()
    assert [(r["epoch"], r["training"], r["validation"]) for r in outer] == [(1, 3.0, 4.0), (2, 2.0, None)]
    back = runlog.metric_events(wide.select("phase", "epoch", "loss"), ["loss"], ["phase", "epoch"])
    assert back.count() == 3


def test_outer_join_of_metric_frames(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "epoch INT, a DOUBLE")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "epoch INT, b DOUBLE")
    out = joins.join_metric_frames([a, b]).orderBy("epoch").collect()
    assert [tuple(r) for r in out] == [(1, 1.0, None), (2, 2.0, 5.0), (3, None, 6.0)]


def test_lookup(spark):
    a = spark.createDataFrame([(1,), (2,)], "k INT")
    b = spark.createDataFrame([(1, "x")], "k INT, name STRING")
    assert {r["k"]: r["name"] for r in joins.lookup(a, b, "k").collect()} == {1: "x", 2: None}
    assert joins.lookup(a, b, "k", "drop").count() == 1


def test_history(spark):
    df = spark.createDataFrame([("t", 1, [1.0, 2.0], [[3.0, 4.0], [5.0, 6.0]])], "phase STRING, epoch INT, a ARRAY<DOUBLE>, b ARRAY<ARRAY<DOUBLE>>")
    out = runlog.history_rows(df, ["phase", "epoch"], {"a": None, "b": 2}).orderBy("ix").collect()
    assert [(r["ix"], r["a"], r["b_0"], r["b_1"]) for r in out] == [(0, 1.0, 3.0, 4.0), (1, 2.0, 5.0, 6.0)]
    with pytest.raises(ValueError):
        runlog.history_rows(df, ["phase"], {"epoch": None})
    with pytest.raises(ValueError):
        runlog.history_rows(df, ["phase"], {"a": 2})
    with pytest.raises(Exception, match="differ in length"):
        runlog.history_rows(df.withColumn("a", F.array(F.lit(1.0))), ["phase"], {"a": None, "b": 2}).collect()


def test_run_parameters(spark):
    out = runlog.run_parameters(spark, {"lr": 1, "id": "x"}, {"lr": 2}).first()["params"]
    assert out == {"lr": "2", "id": "x"}


def test_cells_stay_small_whatever_the_number_of_rows():
    for rows in (0, 1, 10**5, 10**9, 10**12, 10**15):
        assert rows / 16 ** sampling.cell_digits(rows) <= sampling.CELL_ROWS
    assert sampling.cell_digits(10**9) == 4 and sampling.cell_digits(10**12) > 4


@pytest.mark.parametrize("limit", [50_000, 3])
def test_hash_order_in_two_levels(spark, limit, monkeypatch):
    """Small cells and a short first level give the same positions as one sort."""
    monkeypatch.setattr(sampling, "CELL_ROWS", limit)
    monkeypatch.setattr(sampling, "FIRST_DIGITS", 1)
    df = spark.range(500).selectExpr("id % 450 AS id", "id AS v")
    got = sampling.hash_position(df, "id", 4, total="n").collect()
    keys = {r["id"]: r["h"] for r in df.select("id", row_hash(["id"], 4).alias("h")).collect()}
    want = sorted(df.collect(), key=lambda r: (keys[r["id"]], r["id"], r["v"]))
    assert [(r["id"], r["v"]) for r in sorted(got, key=lambda r: r["pos"])] == [tuple(r) for r in want]
    assert {r["n"] for r in got} == {500}
    drawn = sampling.sample_with_replacement(df, 200, "id", 4).collect()
    assert len(drawn) == 200 and sorted(r["draw"] for r in drawn) == list(range(200))


def test_padded_batches_of_an_expression(spark):
    df = spark.createDataFrame([(i, " ".join("ab" * i)) for i in range(1, 8)], "id INT, text STRING")
    words = F.transform(F.split("text", " "), lambda w: F.length(w).cast("double"))
    out = splits.padded_batches(df, words, "id", 3, length=F.size(F.split("text", " ")), name="x").orderBy("id").collect()
    assert [len(r["x"]) for r in out] == [6, 6, 6, 12, 12, 12, 14]
    assert [r["len"] for r in out] == [2 * i for i in range(1, 8)] and all(sum(r["x"]) == r["len"] for r in out)
    with pytest.raises(ValueError):
        splits.padded_batches(df, words, "id", 3)
