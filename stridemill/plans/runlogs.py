"""Run-log queries: event types as runs or phases, days as epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.functions.scalars import every_n as on_every_n
from stridemill.operators import joins, runlog, running
from stridemill.plans.registry import query, rounded, table
from stridemill.session import stage

def _squared() -> Column:
    return (F.col("value") - 50) * (F.col("value") - 50)


_DAYS = """
d AS (SELECT event_type AS run, date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS epoch, round(sqrt(avg(power(value - 50, 2))), 6) AS metric
      FROM events GROUP BY ALL)
"""


def _days(spark: SparkSession, folder: str) -> DataFrame:
    """Root mean squared error of the constant forecast 50, per run and epoch.

    The run log is written once: the operators read it more than once and
    should not aggregate the events again.
    """
    return stage(
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("run"), F.unix_date(F.to_date("ts")).alias("epoch"))
        .agg(rounded(F.sqrt(F.avg(_squared()))).alias("metric")),
        "run-log",
    )


def _best_sql(fold: str, start: str, test: str) -> str:
    return f"""
WITH {_DAYS},
b AS (SELECT *, coalesce({fold}(metric) OVER (PARTITION BY run ORDER BY epoch
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '{start}'::DOUBLE) AS best FROM d)
SELECT run, epoch, metric, best, {test} AS improved FROM b
"""


@query(_best_sql("max", "-Infinity", "metric > best"))
def running_best(spark: SparkSession, folder: str) -> DataFrame:
    return running.running_best(_days(spark, folder), "metric").select(
        "run", "epoch", "metric", "best", "improved"
    )


@query(_best_sql("min", "Infinity", "NOT (metric > best)"))
def running_best_decrease(spark: SparkSession, folder: str) -> DataFrame:
    out = running.running_best(_days(spark, folder), "metric", trigger="decrease")
    return out.select("run", "epoch", "metric", "best", "improved")


@query(f"""
WITH {_DAYS}
SELECT run, arg_min(epoch, (-metric, epoch)) AS epoch, max(metric) AS metric FROM d GROUP BY run
""")
def best_epoch(spark: SparkSession, folder: str) -> DataFrame:
    return running.best_epoch(_days(spark, folder), "metric").select("run", "epoch", "metric")


@query("""
WITH c AS (SELECT DISTINCT CASE event_type WHEN 'error' THEN 'best' ELSE dayofyear(ts)::VARCHAR END AS name FROM events)
SELECT max(TRY_CAST(name AS BIGINT)) AS epoch FROM c
""")
def latest_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    name = F.when(F.col("event_type") == "error", "best").otherwise(F.dayofyear("ts").cast("string"))
    return running.latest_checkpoint(table(spark, folder, "events").select(name.alias("name")))


_BATCHES = """
b AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS epoch, event_type AS phase, hour(ts)::INTEGER AS batch_ix,
             sum(power(value - 50, 2)) AS sse, count(*) AS n FROM events GROUP BY ALL)
"""


def _batches(spark: SparkSession, folder: str) -> DataFrame:
    return stage(
        table(spark, folder, "events")
        .groupBy(
            F.unix_date(F.to_date("ts")).alias("epoch"),
            F.col("event_type").alias("phase"),
            F.hour("ts").alias("batch_ix"),
        )
        .agg(F.sum(_squared()).alias("sse"), F.count(F.lit(1)).alias("n")),
        "batch-log",
    )


@query(f"""
WITH {_BATCHES}
SELECT epoch, phase, batch_ix, round(sqrt(sum(sse) OVER w / sum(n) OVER w), 6) AS rmse
FROM b WINDOW w AS (ORDER BY epoch, phase, batch_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def cumulative_metric(spark: SparkSession, folder: str) -> DataFrame:
    """One long series over all epochs and phases, without a single-task window."""
    out = running.cumulative_metric(
        _batches(spark, folder), "sse", "n", ["epoch", "phase", "batch_ix"], column="mse", chunk_rows=500
    )
    return out.select("epoch", "phase", "batch_ix", rounded(F.sqrt("mse")).alias("rmse"))


@query(f"""
WITH {_BATCHES}
SELECT epoch, phase, batch_ix, sum(n) OVER (PARTITION BY epoch, phase ORDER BY batch_ix)::BIGINT AS seen,
       sum(n) OVER (PARTITION BY epoch, phase)::BIGINT AS total,
       round(100.0 * sum(n) OVER (PARTITION BY epoch, phase ORDER BY batch_ix)
             / sum(n) OVER (PARTITION BY epoch, phase), 6) AS percent
FROM b
""")
def progress(spark: SparkSession, folder: str) -> DataFrame:
    out = running.progress(_batches(spark, folder), "n", "batch_ix", ["epoch", "phase"])
    return out.select("epoch", "phase", "batch_ix", "seen", "total", rounded("percent").alias("percent"))


@query(f"WITH {_DAYS} SELECT run, arg_max(metric, epoch) AS metric, max(epoch) AS epoch FROM d GROUP BY run")
def latest_metric(spark: SparkSession, folder: str) -> DataFrame:
    return running.latest_values(_days(spark, folder), "metric", "epoch", "run")


@query(f"""
WITH {_BATCHES}
SELECT epoch, phase, batch_ix, n FROM b WHERE epoch % 5 = 0 AND (batch_ix + 1) % 4 = 0
""")
def every_n(spark: SparkSession, folder: str) -> DataFrame:
    """The reporting cadence: every fifth epoch, every fourth batch."""
    rows = _batches(spark, folder).where(on_every_n("epoch", 5) & on_every_n("batch_ix", 4, zero_based=True))
    return rows.select("epoch", "phase", "batch_ix", "n")


_METRICS = """
m AS (SELECT event_type AS run, CASE WHEN hour(ts) < 16 THEN 'training' ELSE 'validation' END AS phase,
             date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS epoch, round(sqrt(avg(power(value - 50, 2))), 6) AS loss, max(value) AS peak
      FROM events GROUP BY ALL)
"""


def _metric_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Long metric events: two metrics per run, phase and epoch, written once."""
    wide = (
        table(spark, folder, "events")
        .groupBy(
            F.col("event_type").alias("run"),
            F.when(F.hour("ts") < 16, "training").otherwise("validation").alias("phase"),
            F.unix_date(F.to_date("ts")).alias("epoch"),
        )
        .agg(rounded(F.sqrt(F.avg(_squared()))).alias("loss"), F.max("value").alias("peak"))
    )
    return runlog.metric_events(stage(wide, "metric-log"), ["loss", "peak"], ["run", "phase", "epoch"])


@query(f"WITH {_METRICS} SELECT run, phase, epoch, loss, peak FROM m")
def metrics_wide(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.metrics_wide(_metric_rows(spark, folder), ["loss", "peak"], ["run", "phase", "epoch"])


@query(f"""
WITH {_METRICS}
SELECT run, epoch, t.loss AS training, v.loss AS validation
FROM (SELECT * FROM m WHERE phase = 'training') t JOIN (SELECT * FROM m WHERE phase = 'validation') v USING (run, epoch)
""")
def learning_curve(spark: SparkSession, folder: str) -> DataFrame:
    return joins.learning_curve(_metric_rows(spark, folder), "loss")


@query(f"""
WITH {_METRICS}
SELECT coalesce(t.run, v.run) AS run, coalesce(t.epoch, v.epoch) AS epoch, t.loss AS loss, v.peak AS peak
FROM (SELECT * FROM m WHERE phase = 'training' AND loss < 50) t
FULL JOIN (SELECT * FROM m WHERE phase = 'validation' AND peak > 150) v ON t.run = v.run AND t.epoch = v.epoch
""")
def metric_frames_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Training losses below 50 and validation peaks above 150: either may miss an epoch."""
    rows = _metric_rows(spark, folder)
    loss = rows.where((F.col("phase") == "training") & (F.col("metric") == "loss") & (F.col("value") < 50))
    peak = rows.where((F.col("phase") == "validation") & (F.col("metric") == "peak") & (F.col("value") > 150))
    return joins.join_metric_frames(
        [
            loss.select("run", "epoch", F.col("value").alias("loss")),
            peak.select("run", "epoch", F.col("value").alias("peak")),
        ],
        ["run", "epoch"],
    )


@query("""
SELECT vec_id, i::INTEGER AS ix, embedding[i + 1]::DOUBLE AS v, embedding[i + 1]::DOUBLE * 2 AS pair_0,
       i::DOUBLE AS pair_1
FROM embeddings, generate_series(0, 63) t(i)
""")
def history_explode(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    histories = table(spark, folder, "embeddings").select(
        "vec_id",
        x.alias("v"),
        F.transform(x, lambda v, i: F.array(v * 2, i.cast("double"))).alias("pair"),
    )
    return runlog.history_rows(histories, ["vec_id"], {"v": None, "pair": 2})


@query("""
WITH h AS (SELECT date_trunc('hour', ts) AS t, event_type AS scale, sum(value) AS power FROM events GROUP BY ALL)
SELECT date_diff('day', DATE '1970-01-01', t::DATE)::INTEGER AS day, hour(t)::INTEGER AS hour, scale, round(power / max(power) OVER (PARTITION BY t), 6) AS power FROM h
""")
def column_max_normalise(spark: SparkSession, folder: str) -> DataFrame:
    hours = stage(
        table(spark, folder, "events")
        .groupBy(F.unix_date(F.to_date("ts")).alias("day"), F.hour("ts").alias("hour"), F.col("event_type").alias("scale"))
        .agg(F.sum("value").alias("power")),
        "spectrum",
    )
    out = running.column_max_normalise(hours, "power", ["day", "hour"])
    return out.select("day", "hour", "scale", rounded("power").alias("power"))
