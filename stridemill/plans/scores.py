"""Metrics and losses over the driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.functions import losses
from stridemill.functions.arrays import argmax, as_doubles, softmax
from stridemill.functions.metrics import (
    Metric, evaluate, explode_elements, finish_states, merge_states, partial_states,
)
from stridemill.operators import evaluation
from stridemill.plans.registry import query, rounded, table


def _regression(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        F.col("l_quantity").alias("prediction"),
        (F.col("l_extendedprice") / 1000).alias("target"),
    )


@query("""
SELECT l_returnflag, count(*) AS nobs, round(avg(power(l_quantity - l_extendedprice / 1000, 2)), 6) AS mse
FROM lineitem GROUP BY l_returnflag
""")
def mse_state_merge(spark: SparkSession, folder: str) -> DataFrame:
    """States per flag and status, merged to states per flag."""
    parts = partial_states(_regression(spark, folder), ["mse"], by=["l_returnflag", "l_linestatus"])
    merged = merge_states(parts, ["mse"], "l_returnflag")
    out = finish_states(merged, ["mse"], ["l_returnflag", "mse__nobs"]).withColumnRenamed("mse__nobs", "nobs")
    return out.withColumn("mse", rounded("mse"))


@query("""
SELECT l_returnflag, l_linestatus, round(power(corr(l_quantity, l_extendedprice), 2), 6) AS r2
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def r2_by_group(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate(_regression(spark, folder), ["r2"], by=["l_returnflag", "l_linestatus"])
    return out.withColumn("r2", rounded("r2"))


@query("""
SELECT l_linestatus, round(power(corr(l_quantity, l_extendedprice), 2), 6) AS r2,
       round(100 * avg(abs((l_quantity - l_extendedprice / 1000) / (l_extendedprice / 1000 + 1e-6))), 6) AS mape
FROM lineitem GROUP BY l_linestatus
""")
def r2_merged_from_parts(spark: SparkSession, folder: str) -> DataFrame:
    metrics = ["r2", "mape"]
    parts = partial_states(_regression(spark, folder), metrics, by=["l_returnflag", "l_linestatus"])
    out = finish_states(merge_states(parts, metrics, "l_linestatus"), metrics, "l_linestatus")
    return out.select("l_linestatus", rounded("r2").alias("r2"), rounded("mape").alias("mape"))


def _logits(spark: SparkSession, folder: str) -> DataFrame:
    """All 64 elements as class scores; labels use the first ten classes."""
    return table(spark, folder, "embeddings").select("vec_id", "label", as_doubles("embedding").alias("z"))


_LOGITS = """
e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS z, generate_subscripts(embedding, 1) - 1 AS c
      FROM embeddings),
m AS (SELECT vec_id, max(z) AS top FROM e GROUP BY vec_id),
n AS (SELECT vec_id, top + ln(sum(exp(z - top))) AS lse FROM e JOIN m USING (vec_id) GROUP BY vec_id, top),
p AS (SELECT vec_id, label, c, exp(z - lse) AS p, ln(1) AS zero FROM e JOIN n USING (vec_id))
"""


@query("""
SELECT label, round(100.0 * avg((list_position(embedding, list_max(embedding)) - 1 = label)::INTEGER), 6) AS accuracy
FROM embeddings GROUP BY label
""")
def accuracy_argmax(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate(_logits(spark, folder), ["accuracy"], "z", "label", by="label")
    return out.withColumn("accuracy", rounded("accuracy"))


_CONFUSION = """
k AS (SELECT a.i AS y_true, b.i AS y_pred FROM generate_series(0, 63) a(i), generate_series(0, 63) b(i)),
c AS (SELECT label AS y_true, list_position(embedding, list_max(embedding)) - 1 AS y_pred, count(*) AS n
      FROM embeddings GROUP BY ALL),
f AS (SELECT k.y_true, k.y_pred, coalesce(c.n, 0) AS n FROM k LEFT JOIN c USING (y_true, y_pred))
"""


@query(f"WITH {_CONFUSION} SELECT * FROM f")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.confusion_matrix(_logits(spark, folder), "label", argmax("z"), 64)


@query(f"""
WITH {_CONFUSION}
SELECT y_true, y_pred, n, round(n / nullif(sum(n) OVER (PARTITION BY y_true), 0)::DOUBLE, 6) AS share FROM f
""")
def confusion_normalised(spark: SparkSession, folder: str) -> DataFrame:
    counts = evaluation.confusion_matrix(_logits(spark, folder), "label", argmax("z"), 64)
    return evaluation.normalise_rows(counts).withColumn("share", rounded("share"))


@query(f"WITH {_LOGITS} SELECT vec_id, round(-ln(p), 6) AS loss FROM p WHERE c = label")
def cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluation.apply_criterion(_logits(spark, folder), "cross_entropy", "z", "label")
    return out.select("vec_id", rounded("loss").alias("loss"))


@query(f"WITH {_LOGITS} SELECT vec_id, c::INTEGER AS c, round(p, 8) AS p FROM p")
def softmax_rows(spark: SparkSession, folder: str) -> DataFrame:
    out = _logits(spark, folder).select("vec_id", F.posexplode(softmax("z")).alias("c", "p"))
    return out.withColumn("p", rounded("p", 8))


@query("""
SELECT vec_id, c::INTEGER AS c, (c = label)::INTEGER + 1e-6::DOUBLE AS v
FROM embeddings, generate_series(0, 9) t(c)
""")
def one_hot_eps(spark: SparkSession, folder: str) -> DataFrame:
    hot = losses.one_hot("label", 10)
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(hot).alias("c", "v"))


def _pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Images of 16 pixels, one vector per pixel."""
    return _logits(spark, folder).select(
        F.floor(F.col("vec_id") / 16).alias("sample"), F.col("z").alias("logits"), F.col("label").alias("target")
    )


_IMAGES = _LOGITS + """,
i AS (SELECT vec_id // 16 AS sample, p, (c = label)::INTEGER + 1e-6::DOUBLE AS t, vec_id FROM p),
dice AS (SELECT sample, 1 - 2 * sum(p * t) / (sum(p + t) + 1e-8) AS loss FROM i GROUP BY sample)
"""


def _focal(alpha: float, gamma: float) -> str:
    return f"""
fpix AS (SELECT sample, vec_id, sum(t * -{alpha}::DOUBLE * power(greatest(1 - (p + 1e-8), 0), {gamma}) * ln(p + 1e-8)) AS f
         FROM i GROUP BY sample, vec_id),
focal AS (SELECT sample, avg(f) AS loss FROM fpix GROUP BY sample)
"""


@query(f"WITH {_IMAGES} SELECT sample, round(loss, 6) AS loss FROM dice")
def dice_loss(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluation.dice_loss(_pixels(spark, folder), "sample", reduction="none")
    return out.withColumn("loss", rounded("loss"))


@query(f"WITH {_IMAGES}, {_focal(0.5, 2.0)} SELECT sample, round(loss, 6) AS loss FROM focal")
def focal_loss(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluation.focal_loss(_pixels(spark, folder), "sample", alpha=0.5)
    return out.withColumn("loss", rounded("loss"))


@query(f"""
WITH {_IMAGES}, {_focal(0.48, 1.1)}
SELECT round((SELECT avg(loss) FROM focal) - ln((SELECT avg(loss) FROM dice)), 6) AS loss
""")
def mixed_loss(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.mixed_loss(_pixels(spark, folder), "sample").select(rounded("loss").alias("loss"))


@query(f"""
WITH {_IMAGES}, {_focal(0.25, 2.0)}
SELECT 'dice' AS name, 'mean' AS reduction, round(avg(loss), 6) AS loss FROM dice
UNION ALL SELECT 'dice', 'sum', round(sum(loss), 6) FROM dice
UNION ALL SELECT 'focal', 'mean', round(avg(loss), 6) FROM focal
UNION ALL SELECT 'focal', 'sum', round(sum(loss), 6) FROM focal
""")
def loss_reductions(spark: SparkSession, folder: str) -> DataFrame:
    images = evaluation.image_losses(_pixels(spark, folder), "sample", alpha=0.25)
    folds = {
        f"{name}_{how}": fold(name) for name in ("dice", "focal") for how, fold in (("mean", F.avg), ("sum", F.sum))
    }
    wide = images.agg(*[rounded(c).alias(n) for n, c in folds.items()])
    long = wide.unpivot([], list(folds), "name", "loss")
    parts = F.split("name", "_")
    return long.select(F.get(parts, 0).alias("name"), F.get(parts, 1).alias("reduction"), "loss")


@query("""
WITH b AS (SELECT doc_id, n_chars / 1000.0::DOUBLE - 1 AS x, toxic::DOUBLE AS t FROM documents JOIN labels USING (doc_id)),
s AS (SELECT doc_id, t, CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END AS p FROM b)
SELECT doc_id, round(-0.25 * power(1 - p + 1e-8, 2) * t * ln(p + 1e-8)
                     - 0.75 * power(p + 1e-8, 2) * (1 - t) * ln(1 - p + 1e-8), 6) + 0.0 AS loss
FROM s
""")
def binary_focal(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", (F.col("n_chars") / 1000 - 1).alias("logit"))
    marked = table(spark, folder, "labels").select("doc_id", F.col("toxic").cast("double").alias("toxic"))
    out = evaluation.apply_criterion(docs.join(marked, "doc_id"), "binary_focal", "logit", "toxic")
    return out.select("doc_id", rounded("loss").alias("loss"))


@query("""
WITH h AS (SELECT label, unnest(embedding[1:32])::DOUBLE AS m, unnest(embedding[33:64])::DOUBLE AS v FROM embeddings)
SELECT label, round(-0.5 * avg(1 + v - m * m - exp(v)), 6) AS kl,
       round(sum(power(m - v, 2)), 6) AS reconstruction,
       round(-0.5 * avg(1 + v - m * m - exp(v)) + sum(power(m - v, 2)), 6) AS loss
FROM h GROUP BY label
""")
def kl_joint_loss(spark: SparkSession, folder: str) -> DataFrame:
    halves = _logits(spark, folder).select(
        "label", F.slice("z", 1, 32).alias("mean"), F.slice("z", 33, 32).alias("logvar")
    )
    out = evaluation.joint_loss(halves, "mean", "logvar", by="label")
    return out.select("label", *[rounded(c).alias(c) for c in ("kl", "reconstruction", "loss")])


@query("""
WITH h AS (SELECT label, unnest(embedding[1:32])::DOUBLE AS p, unnest(embedding[33:64])::DOUBLE AS t FROM embeddings)
SELECT label, round(avg(power(p - t, 2)), 6) AS mse, round(avg(abs(p - t)), 6) AS mae FROM h GROUP BY label
""")
def array_element_errors(spark: SparkSession, folder: str) -> DataFrame:
    halves = _logits(spark, folder).select(
        "label", F.slice("z", 1, 32).alias("prediction"), F.slice("z", 33, 32).alias("target")
    )
    out = evaluate(explode_elements(halves, "prediction", "target"), ["mse", "mae"], by="label")
    return out.select("label", rounded("mse").alias("mse"), rounded("mae").alias("mae"))


_LOSS_ROWS = """
r AS (SELECT CASE l_linestatus WHEN 'F' THEN 'training' ELSE 'validation' END AS phase,
             year(l_shipdate)::INTEGER AS epoch, (l_linenumber % 2)::INTEGER AS loader_ix,
             l_orderkey // 16 AS batch_ix, power(l_quantity - l_extendedprice / 1000, 2) AS loss,
             (l_quantity > l_extendedprice / 1000)::BIGINT AS hit
      FROM lineitem)
"""


def _loss_rows(spark: SparkSession, folder: str) -> DataFrame:
    error = F.col("l_quantity") - F.col("l_extendedprice") / 1000
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "training").otherwise("validation").alias("phase"),
        F.year("l_shipdate").alias("epoch"),
        F.pmod("l_linenumber", F.lit(2)).alias("loader_ix"),
        F.floor(F.col("l_orderkey") / 16).alias("batch_ix"),
        (error * error).alias("loss"),
        (error > 0).cast("long").alias("hit"),
    )


@query(f"""
WITH {_LOSS_ROWS}
SELECT phase, epoch, loader_ix, batch_ix, round(avg(loss), 6) AS loss, count(*) AS n
FROM r GROUP BY phase, epoch, loader_ix, batch_ix
""")
def batch_loss(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.batch_loss(_loss_rows(spark, folder)).withColumn("loss", rounded("loss"))


@query(f"""
WITH {_LOSS_ROWS},
b AS (SELECT phase, epoch, avg(loss) AS loss FROM r GROUP BY phase, epoch, loader_ix, batch_ix)
SELECT phase, epoch, round(e.loss, 6) AS element_loss, round(u.loss, 6) AS batch_loss
FROM (SELECT phase, epoch, avg(loss) AS loss FROM r GROUP BY phase, epoch) e
JOIN (SELECT phase, epoch, avg(loss) AS loss FROM b GROUP BY phase, epoch) u USING (phase, epoch)
""")
def batch_epoch_loss(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluation.epoch_means(evaluation.batch_loss(_loss_rows(spark, folder)))
    return out.select(
        "phase", "epoch", rounded("element_loss").alias("element_loss"), rounded("batch_loss").alias("batch_loss")
    )


@query(f"""
WITH {_LOSS_ROWS}
SELECT phase, epoch, round(avg(loss), 6) AS loss, round(avg(hit), 6) AS accuracy FROM r GROUP BY phase, epoch
""")
def weighted_epoch_loss(spark: SparkSession, folder: str) -> DataFrame:
    batches = _loss_rows(spark, folder).groupBy(*evaluation.BATCH_KEYS).agg(
        F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n"), F.sum("hit").alias("correct")
    )
    out = evaluation.weighted_epoch(batches, correct="correct")
    return out.select("phase", "epoch", rounded("loss").alias("loss"), rounded("accuracy").alias("accuracy"))


@query("""
SELECT l_returnflag, round(avg(ln(cosh((l_quantity - l_extendedprice / 1000) / 10))), 6) AS log_cosh
FROM lineitem GROUP BY l_returnflag
""")
def user_metric(spark: SparkSession, folder: str) -> DataFrame:
    """A metric written in numpy: partial states per Arrow batch, merged by sum."""
    import numpy as np

    def update(p: pd.Series, t: pd.Series) -> dict[str, float]:
        return {"total": np.log(np.cosh((p - t) / 10)).sum(), "rows": len(p)}

    out = evaluation.batch_metric(
        _regression(spark, folder), update, ["total", "rows"],
        lambda s: F.try_divide(s["total"], s["rows"]), by="l_returnflag", name="log_cosh",
    )
    return out.withColumn("log_cosh", rounded("log_cosh"))


@query("""
SELECT l_returnflag, round(100.0 * avg((abs(l_quantity - l_extendedprice / 1000) < 5)::INTEGER), 6) AS within_five
FROM lineitem GROUP BY l_returnflag
""")
def user_metric_column(spark: SparkSession, folder: str) -> DataFrame:
    """A user metric as column expressions, with the same state protocol."""
    within = Metric(
        "within_five",
        lambda p, t: {"near": F.count(F.when(F.abs(p - t) < 5, 1)), "rows": F.count(F.lit(1))},
        lambda s: 100 * F.try_divide(s["near"], s["rows"]),
    )
    out = evaluate(_regression(spark, folder), [within], by="l_returnflag")
    return out.withColumn("within_five", rounded("within_five"))


@query("""
WITH d AS (SELECT l_returnflag, abs(l_quantity - l_extendedprice / 1000) AS e FROM lineitem)
SELECT l_returnflag, round(avg(CASE WHEN e <= 10 THEN 0.5 * e * e ELSE 10 * (e - 5) END), 6) AS loss
FROM d GROUP BY l_returnflag
""")
def user_criterion(spark: SparkSession, folder: str) -> DataFrame:
    """A criterion the user writes as a pandas function of two columns."""
    import numpy as np

    @F.pandas_udf("double")
    def huber(p: pd.Series, t: pd.Series) -> pd.Series:
        e = (p - t).abs()
        return pd.Series(np.where(e <= 10, 0.5 * e * e, 10 * (e - 5)))

    rows = evaluation.apply_criterion(_regression(spark, folder), huber)
    out = losses.reduce_loss(rows, "loss", "mean", "l_returnflag")
    return out.withColumn("loss", rounded("loss"))


@query("""
SELECT l_returnflag, round(avg(abs(l_quantity - l_extendedprice / 1000)), 6) AS mean_distance,
       round(100.0 * avg((l_quantity > l_extendedprice / 1000)::INTEGER), 6) AS above,
       round(100 * avg(abs((l_quantity - l_extendedprice / 1000) / (l_extendedprice / 1000 + 1e-6))), 6) AS mape
FROM lineitem GROUP BY l_returnflag
""")
def user_metrics_together(spark: SparkSession, folder: str) -> DataFrame:
    """Two user metrics whose states have the same names, beside a built-in one."""
    distance = Metric(
        "mean_distance",
        lambda p, t: {"total": F.sum(F.abs(p - t)), "rows": F.count(F.lit(1))},
        lambda s: F.try_divide(s["total"], s["rows"]),
    )
    above = Metric(
        "above",
        lambda p, t: {"total": F.sum((p > t).cast("double")), "rows": F.count(F.lit(1))},
        lambda s: 100 * F.try_divide(s["total"], s["rows"]),
    )
    out = evaluate(_regression(spark, folder), [distance, above, "mape"], by="l_returnflag")
    return out.select("l_returnflag", *[rounded(c).alias(c) for c in ("mean_distance", "above", "mape")])


@query("""
SELECT l_linestatus, round(power(corr(l_quantity, l_extendedprice), 2), 4) AS r2 FROM lineitem GROUP BY l_linestatus
""")
def r2_merged_large_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Merged states of values around a thousand million."""
    far = _regression(spark, folder).withColumns(
        {c: F.col(c).cast("double") + F.lit(1e9) for c in ("prediction", "target")}
    )
    parts = partial_states(far, ["r2"], by=["l_returnflag", "l_linestatus"])
    out = finish_states(merge_states(parts, ["r2"], "l_linestatus"), ["r2"], "l_linestatus")
    return out.select("l_linestatus", rounded("r2", 4).alias("r2"))
