"""Streaming queries: the events table as a file stream, run until it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.operators.order import range_partitions
from stridemill.plans.registry import micros, query, rounded, table
from stridemill.session import fresh_path
from stridemill.streaming import jobs
from stridemill.streaming.latest import LatestTable


FILES, FILES_PER_BATCH = 6, 2
DAY = 86_400_000_000
#: Rows reach a stream up to six hours late, in four batches of eight days; one in fifty is two batches late.
DISORDER, SPAN, DELAY = 21_600, 8 * DAY, "6 hours"
#: Rows of a table for each shard of the look-ahead state.
SHARD_ROWS = 100_000


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The table rewritten as six files in order of ``event_id``, two per micro-batch.

    Event times come in any order then.
    """
    path = fresh_path(spark, "event-files")
    events = table(spark, folder, "events")
    events.repartitionByRange(FILES, "event_id").write.parquet(path)
    return jobs.read_files(spark, path, events.schema, FILES_PER_BATCH)


def _arrivals(spark: SparkSession, folder: str, closing: bool = False) -> DataFrame:
    """The table as a stream in order of arrival, one micro-batch for each eight days.

    ``closing`` adds a last batch with one row of no user, years later, which
    moves the watermark past all others.
    """
    path = fresh_path(spark, "arrivals")
    events = table(spark, folder, "events")
    first, last = events.agg(F.min(micros()), F.max(micros())).first()
    top = (last + DISORDER * 1_000_000 - first) // SPAN
    usual = F.expr(f"(unix_micros(CAST(ts AS timestamp)) + event_id * 7919 % {DISORDER} * 1000000 - {first}) div {SPAN}")
    number = F.when(F.col("event_id") % 50 == 0, F.least(usual + 2, F.lit(top))).otherwise(usual)
    files = range_partitions(events) or 1
    for k in range(top + 1):
        events.where(number == k).repartition(files).write.mode("append").parquet(path)
    if closing:
        end = events.agg(F.max("ts").alias("ts"), F.max("event_id").alias("event_id")).select(
            (F.col("ts") + F.expr("INTERVAL 10 YEARS")).alias("ts"), (F.col("event_id") + 1).alias("event_id")
        )
        empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields}
        row = end.select(*[F.col(c) if c in ("ts", "event_id") else empty[c] for c in events.columns])
        row.coalesce(1).write.mode("append").parquet(path)
    return jobs.read_files(spark, path, events.schema, files)


#: Each event with its batch, and the watermark that decides there what is late: the latest time of
#: the batches before the one before, less the delay, in milliseconds.
_ARRIVALS = f"""
  e AS (SELECT *, epoch_us(ts) AS t, min(epoch_us(ts)) OVER () AS first, max(epoch_us(ts)) OVER () AS last FROM events),
  n AS (SELECT *, (t + event_id * 7919 % {DISORDER} * 1000000 - first) // {SPAN} AS usual,
               (last + {DISORDER * 1_000_000} - first) // {SPAN} AS top FROM e),
  b AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN least(usual + 2, top) ELSE usual END AS batch FROM n),
  m AS (SELECT batch, max(t) // 1000 AS top_ms FROM b GROUP BY batch),
  l AS (SELECT b.*, coalesce((SELECT max(top_ms) FROM m WHERE m.batch <= b.batch - 2) - 21600000, 0) * 1000 AS mark FROM b)"""


@query("""
SELECT event_type AS run, round(avg(power(value - 50, 2)), 6) AS mse, round(avg(abs(value - 50)), 6) AS mae
FROM events GROUP BY event_type
""")
def stream_running_mse(spark: SparkSession, folder: str) -> DataFrame:
    """Two files per micro-batch; the last update of each group counts."""
    rows = _event_stream(spark, folder).select(
        F.col("event_type").alias("run"), F.lit(50.0).alias("prediction"), F.col("value").alias("target")
    )
    out, metrics = fresh_path(spark, "running-mse"), ["mse", "mae"]
    states = jobs.running_metric_states(rows, metrics, by="run")
    jobs.write_latest(states, "run", out, fresh_path(spark, "checkpoint")).awaitTermination()
    latest = jobs.read_latest(spark, out, metrics, "run")
    return latest.select("run", rounded("mse").alias("mse"), rounded("mae").alias("mae"))


@query(f"""
WITH {_ARRIVALS},
w AS (
  SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) // 1000000 AS slice_start, value, mark FROM l
  UNION ALL SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) // 1000000 - 1800, value, mark FROM l)
SELECT slice_start, count(*) AS n, round(sum(value), 4) AS total FROM w
WHERE (slice_start + 3600) * 1000000 > mark GROUP BY slice_start
""")
def stream_hopping(spark: SparkSession, folder: str) -> DataFrame:
    """Event-time slices of one hour every half hour, last update of each slice; late rows change none."""
    stream = _arrivals(spark, folder).select("ts", "value")
    slices = jobs.hopping_slices(stream, "ts", "value", "1 hour", "30 minutes", DELAY)
    out = fresh_path(spark, "slices")
    jobs.write_latest(slices, "slice_start", out, fresh_path(spark, "checkpoint")).awaitTermination()
    newest = LatestTable(spark, out, ["slice_start"]).read()
    return newest.select(F.unix_seconds("slice_start").alias("slice_start"), "n", rounded("total", 4).alias("total"))


@query(f"""
WITH {_ARRIVALS}
SELECT user_id, row_number() OVER w - 1 AS pos,
       value AS x0, lead(value) OVER w AS x1, lead(value, 2) OVER w AS x2, lead(value, 3) OVER w AS x3,
       lead(value, 4) OVER w AS target, (SELECT count(*) FROM l WHERE t <= mark) AS late_rows
FROM l WHERE t > mark WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
QUALIFY lead(event_id, 4) OVER w IS NOT NULL
""")
def stream_lookahead(spark: SparkSession, folder: str) -> DataFrame:
    """Samples in event-time order from rows in order of arrival, and how many rows came too late."""
    shards = max(jobs.SHARDS, table(spark, folder, "events").count() // SHARD_ROWS)
    stream = _arrivals(spark, folder, closing=True)
    samples = jobs.lookahead_samples(stream, "value", 4, 1, "user_id", "ts", "event_id", DELAY, shards=shards)
    out = fresh_path(spark, "samples")
    with jobs.state_partitions(spark, shards // 8):
        run = jobs.write_append(samples, out, fresh_path(spark, "checkpoint"))
    run.awaitTermination()
    return spark.read.parquet(out).select(
        "user_id", "pos", *[F.get("x", i).alias(f"x{i}") for i in range(4)], "target",
        F.lit(jobs.late_rows(run)).cast("long").alias("late_rows"),
    )


@query("""
SELECT event_type, count(*) AS n_rows, round(sum(value), 4) AS logged FROM events GROUP BY event_type
""")
def stream_multi_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Every micro-batch to a row table and to a metric log."""
    root = fresh_path(spark, "multi-sink")
    stream = _event_stream(spark, folder).select("event_id", "event_type", "value")
    jobs.write_fan_out(
        stream,
        [
            lambda df, i: df.write.mode("overwrite").parquet(f"{root}/rows/batch={i}"),
            lambda df, i: df.groupBy("event_type")
            .agg(F.sum("value").alias("value"))
            .write.mode("overwrite")
            .parquet(f"{root}/log/batch={i}"),
        ],
        fresh_path(spark, "checkpoint"),
    ).awaitTermination()
    rows = spark.read.parquet(f"{root}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"))
    log = spark.read.parquet(f"{root}/log").groupBy("event_type").agg(rounded(F.sum("value"), 4).alias("logged"))
    return rows.join(log, "event_type")
