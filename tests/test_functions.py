"""Array, scalar, loss and metric expressions against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stridemill.functions import arrays, losses, metrics, scalars

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
floats = st.floats(-50, 50, allow_nan=False)


def one(spark, expression, **values):
    """The value of an expression over one row of array or scalar literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expression.alias("out")).first()["out"]


def softmax(x):
    e = np.exp(np.array(x) - np.max(x))
    return e / e.sum()


# --- arrays -------------------------------------------------------------------


def test_argmax_takes_the_first_of_a_tie(spark):
    assert one(spark, arrays.argmax("a"), a=[1.0, 3.0, 3.0]) == 1
    assert one(spark, arrays.argmax("a"), a=[2.0]) == 0
    assert one(spark, arrays.argmax("a"), a=[2.0, math.nan, 5.0]) == 1


@FEW
@given(st.lists(floats, min_size=1, max_size=6))
def test_softmax_and_log_sum_exp(spark, x):
    assert np.allclose(one(spark, arrays.softmax("a"), a=x), softmax(x))
    assert math.isclose(one(spark, arrays.log_sum_exp("a"), a=x), np.logaddexp.reduce(x), abs_tol=1e-9)


def test_large_logits_do_not_overflow(spark):
    assert np.allclose(one(spark, arrays.softmax("a"), a=[1000.0, 1000.0, -1000.0]), [0.5, 0.5, 0.0])


@pytest.mark.parametrize("x", [-800.0, -3.0, 0.0, 2.5, 800.0])
def test_sigmoid(spark, x):
    want = 1 / (1 + math.exp(-x)) if x > -700 else 0.0
    assert math.isclose(one(spark, arrays.sigmoid("x"), x=x), want, abs_tol=1e-12)


def test_relu_and_clamp(spark):
    assert one(spark, arrays.relu("x"), x=-2.0) == 0.0
    assert one(spark, arrays.relu("x"), x=2.0) == 2.0
    assert [one(spark, arrays.clamp("x", 0, 1), x=v) for v in (-1.0, 0.5, 3.0)] == [0.0, 0.5, 1.0]


def test_layout(spark):
    m = F.array(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(5.0), F.lit(6.0)))
    df = spark.range(1).select(m.alias("m"))
    row = df.select(
        arrays.transpose("m").alias("t"),
        arrays.flatten("m").alias("f"),
        arrays.transpose(arrays.transpose("m")).alias("tt"),
        arrays.expand_dims(F.get("m", 0)).alias("e"),
        arrays.squeeze(arrays.unsqueeze("m")).alias("s"),
        arrays.stitch_channels(F.get("m", 0), F.get("m", 1)).alias("c"),
        arrays.pad_to(F.get("m", 0), F.lit(5)).alias("p"),
        arrays.pad_to(F.get("m", 0), F.lit(2)).alias("q"),
    ).first()
    assert row["t"] == row["c"] == [[1, 4], [2, 5], [3, 6]]
    assert row["tt"] == row["s"] == [[1, 2, 3], [4, 5, 6]]
    assert row["f"] == [1, 2, 3, 4, 5, 6]
    assert row["e"] == [[1], [2], [3]]
    assert row["p"] == [1, 2, 3, 0, 0] and row["q"] == [1, 2, 3]


def test_layout_errors(spark):
    ragged = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0)))
    with pytest.raises(Exception, match="differ in length"):
        spark.range(1).select(arrays.transpose(ragged)).collect()
    with pytest.raises(Exception, match="length 1"):
        spark.range(1).select(arrays.squeeze(ragged)).collect()
    with pytest.raises(ValueError):
        arrays.split_features(["only"])


def test_transpose_of_empty_rows(spark):
    empty = F.array(F.array().cast("array<double>"), F.array().cast("array<double>"))
    assert spark.range(1).select(arrays.transpose(empty).alias("t")).first()["t"] == []


def test_indices_of_zero_is_empty(spark):
    assert one(spark, arrays.indices(F.col("n")), n=0) == []
    assert one(spark, arrays.indices(F.col("n")), n=3) == [0, 1, 2]


# --- scalars ------------------------------------------------------------------


def test_merge_maps_later_wins(spark):
    out = spark.sql("SELECT map('a', '1', 'b', '2') AS x, map('b', '3', 'c', '4') AS y").select(
        scalars.merge_maps("x", "y").alias("m")
    ).first()["m"]
    assert out == {"a": "1", "b": "3", "c": "4"}


def test_paths(spark):
    assert one(spark, scalars.file_name("p"), p="http://a/b/train.gz") == "train.gz"
    assert one(spark, scalars.drop_suffix("p", ".gz"), p="train.gz") == "train"
    assert one(spark, scalars.drop_suffix("p", ".gz"), p="train.zip") == "train.zip"
    assert one(spark, scalars.file_stem("p"), p="x/cut.1.tdms") == "cut.1"
    assert one(spark, scalars.file_stem("p"), p="x/.hidden") == ".hidden"
    assert one(spark, scalars.file_stem("p"), p="noext") == "noext"


def test_bin_edges(spark):
    rows = [(-0.03,), (-0.02,), (0.0,), (0.02,), (0.03,), (math.nan,), (None,)]
    out = spark.createDataFrame(rows, "y DOUBLE").select(scalars.bin_label("y").alias("b")).collect()
    assert [r["b"] for r in out] == [0, 0, 1, 1, 2, 1, None]


def test_every_n(spark):
    df = spark.range(7)
    assert [r[0] for r in df.where(scalars.every_n("id", 3)).collect()] == [0, 3, 6]
    assert [r[0] for r in df.where(scalars.every_n("id", 3, zero_based=True)).collect()] == [2, 5]
    with pytest.raises(ValueError):
        scalars.every_n("id", 0)


def test_hash_noise_is_standard_normal_and_repeatable(spark):
    z = scalars.hash_normal(scalars.row_hash(["id"], 1))
    first = [r[0] for r in spark.range(4000).select(z).collect()]
    again = sorted(r[0] for r in spark.range(4000).repartition(7).select(z).collect())
    assert sorted(first) == again
    assert abs(np.mean(first)) < 0.06 and abs(np.std(first) - 1) < 0.05


# --- losses -------------------------------------------------------------------


def test_binary_focal_golden(spark):
    df = spark.createDataFrame([(6.325, 1.0), (5.26, 1.0), (87.49, 0.0)], "x DOUBLE, t DOUBLE")
    out = losses.reduce_loss(df.select(losses.binary_focal("x", "t").alias("loss")), how="mean")
    assert round(out.first()["loss"], 4) == 4.6052


@FEW
@given(st.lists(floats, min_size=2, max_size=5), st.integers(0, 1))
def test_cross_entropy(spark, logits, target):
    got = one(spark, losses.cross_entropy("a", "t"), a=logits, t=target)
    assert math.isclose(got, np.logaddexp.reduce(logits) - logits[target], abs_tol=1e-9)


def test_target_outside_the_classes(spark):
    for t in (-1, 3):
        with pytest.raises(Exception, match="class range"):
            one(spark, losses.cross_entropy("a", "t"), a=[1.0, 2.0, 3.0], t=t)


def test_one_hot(spark):
    assert one(spark, losses.one_hot("y", 3), y=1) == [1e-6, 1.000001, 1e-6]
    assert one(spark, losses.one_hot("y", 1, 0.0), y=0) == [1.0]
    with pytest.raises(ValueError):
        losses.one_hot("y", 0)


def test_focal_pixel_with_saturated_probability(spark):
    got = one(spark, losses.focal_pixel("a", "t", 0.48, 1.1), a=[200.0, -200.0], t=0)
    assert math.isfinite(got) and got < 1e-4


def test_reductions(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "g INT, loss DOUBLE")
    assert losses.reduce_loss(df, how="none").count() == 3
    assert losses.reduce_loss(df, how="mean").first()["loss"] == 3.0
    assert losses.reduce_loss(df, how="sum").first()["loss"] == 9.0
    per = {r["g"]: r["loss"] for r in losses.reduce_loss(df, how="sum", by="g").collect()}
    assert per == {1: 4.0, 2: 5.0}
    with pytest.raises(ValueError):
        losses.reduce_loss(df, how="median")


def test_squared_errors(spark):
    assert one(spark, losses.squared_error("a", "b"), a=3.0, b=1.0) == 4.0
    assert one(spark, losses.squared_error_sum("a", "b"), a=[1.0, 2.0], b=[0.0, 4.0]) == 5.0
    with pytest.raises(Exception, match="differ in length"):
        one(spark, losses.squared_error_sum("a", "b"), a=[1.0, 2.0], b=[0.0])


# --- metrics ------------------------------------------------------------------

PAIRS = [(2.0, 3.0), (8.0, 8.0), (10.0, 10.0), (13.0, 17.0), (18.0, 24.0), (20.0, 27.0)]
ALL = ["mse", "rmse", "mae", "mape", "accuracybar", "r2"]


def expected(pairs):
    p, t = np.array(pairs).T
    e = p - t
    return {
        "mse": (e**2).mean(),
        "rmse": math.sqrt((e**2).mean() + 1e-6),
        "mae": abs(e).mean(),
        "mape": 100 * abs(p / (t + 1e-6) - t / (t + 1e-6)).mean(),
        "accuracybar": 100 * (1 - abs(e).mean() / t.mean()),
        "r2": np.corrcoef(p, t)[0, 1] ** 2,
    }


def test_golden_r2_and_the_other_metrics(spark):
    df = spark.createDataFrame(PAIRS, "prediction DOUBLE, target DOUBLE")
    out = metrics.evaluate(df, ALL).first().asDict()
    assert round(out["r2"], 4) == 0.9729
    for name, value in expected(PAIRS).items():
        assert math.isclose(out[name], value, rel_tol=1e-12), name


@FEW
@given(st.lists(st.tuples(floats, st.floats(1, 50), st.integers(0, 3)), min_size=3, max_size=30))
def test_merged_parts_equal_one_pass(spark, rows):
    df = spark.createDataFrame(rows, "prediction DOUBLE, target DOUBLE, part INT")
    whole = metrics.evaluate(df, ALL).first().asDict()
    parts = metrics.partial_states(df, ALL, by="part")
    merged = metrics.finish_states(metrics.merge_states(parts, ALL), ALL).first().asDict()
    for name in ALL[:-1]:
        assert math.isclose(whole[name], merged[name], rel_tol=1e-9, abs_tol=1e-9), name
    spread = min(np.std([r[0] for r in rows]), np.std([r[1] for r in rows]))
    if spread > 0.1:
        assert math.isclose(whole["r2"], merged["r2"], rel_tol=1e-6, abs_tol=1e-9)


def test_constant_column_gives_null_r2(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "prediction DOUBLE, target DOUBLE")
    assert metrics.evaluate(df, ["r2"]).first()["r2"] is None
    assert metrics.evaluate(df.limit(1), ["r2"]).first()["r2"] is None


def test_metrics_of_nothing_and_of_zero_targets(spark):
    none = spark.createDataFrame([], "prediction DOUBLE, target DOUBLE")
    assert set(metrics.evaluate(none, ALL[:-1]).first().asDict().values()) == {None}
    zero = spark.createDataFrame([(1.0, 0.0)], "prediction DOUBLE, target DOUBLE")
    assert metrics.evaluate(zero, ["accuracybar"]).first()[0] is None


def test_accuracy_and_groups(spark):
    df = spark.createDataFrame(
        [("a", [0.1, 0.9], 1), ("a", [0.5, 0.5], 0), ("b", [0.9, 0.1], 1)], "g STRING, prediction ARRAY<DOUBLE>, target INT"
    )
    out = {r["g"]: r["accuracy"] for r in metrics.evaluate(df, ["accuracy"], by="g").collect()}
    assert out == {"a": 100.0, "b": 0.0}


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        metrics.resolve(["f1"])


def test_elements_are_counted_one_by_one(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 4.0]), ([3.0], [6.0])], "p ARRAY<DOUBLE>, t ARRAY<DOUBLE>")
    out = metrics.evaluate(metrics.explode_elements(df, "p", "t"), ["mse"], "p", "t").first()["mse"]
    assert math.isclose(out, (0 + 4 + 9) / 3)
    bad = spark.createDataFrame([([1.0], [1.0, 4.0])], "p ARRAY<DOUBLE>, t ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="differ in length"):
        metrics.explode_elements(bad, "p", "t").collect()
