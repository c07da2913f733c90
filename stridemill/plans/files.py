"""Sources and sinks: files derived from the driver tables, written and read back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.functions.arrays import as_doubles
from stridemill.functions.scalars import merge_maps
from stridemill.operators.order import with_position
from stridemill.plans.registry import query, rounded, table
from stridemill.plans.runlogs import _metric_rows
from stridemill.session import fresh_path
from stridemill.sources import files, idx, sinks, text

# Images per file and vectors per write task.
IMAGES_PER_FILE = 256


def _write_idx(vectors: DataFrame, folder: str) -> None:
    """8 x 8 byte images and their labels, in files of consecutive ids."""

    def write(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        pixels = np.clip(np.floor((np.stack(group["x"].to_numpy()) + 1) * 128), 0, 255)
        contents = {"images": pixels.reshape(-1, 8, 8), "labels": group["label"].to_numpy()}
        for kind, values in contents.items():
            filesystem, root = fs.FileSystem.from_uri(idx.as_uri(f"{folder}/{kind}"))
            filesystem.create_dir(root, recursive=True)
            with filesystem.open_output_stream(f"{root}/part-{group['block'].iloc[0]:012d}") as out:
                out.write(idx.idx_bytes(values))
        return pd.DataFrame({"n": [len(group)]})

    blocks = vectors.withColumn("block", F.floor(F.col("pos") / IMAGES_PER_FILE))
    blocks.groupBy("block").applyInPandas(write, "n LONG").agg(F.sum("n")).collect()


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", as_doubles("embedding").alias("x"))


_BYTES = """
q AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
b AS (SELECT vec_id, label, i, least(greatest(floor((v + 1) * 128), 0), 255)::BIGINT AS v FROM q)
"""


@query(f"""
WITH {_BYTES},
p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings)
SELECT pos, label::BIGINT AS label, sum(v)::BIGINT AS total, sum(CASE WHEN i // 8 = 2 THEN v END)::BIGINT AS third_row
FROM b JOIN p USING (vec_id) GROUP BY pos, label
""")
def idx_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    root = fresh_path(spark, "idx")
    _write_idx(with_position(_vectors(spark, folder), "vec_id"), root)
    images = idx.read_labelled_images(spark, f"{root}/images", f"{root}/labels")

    def total(a):
        return F.aggregate(a, F.lit(0).cast("long"), lambda acc, v: acc + v)

    return images.select(
        "pos", "label", total(F.flatten("image")).alias("total"), total(F.get("image", 2)).alias("third_row")
    )


@query("""
WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, label::BIGINT AS label, count(*) OVER () AS n FROM embeddings)
SELECT pos, label FROM p WHERE pos BETWEEN n // 3 AND n // 3 + n // 4
""")
def idx_range(spark: SparkSession, folder: str) -> DataFrame:
    """The labels at a range of positions; only their records are read."""
    root = fresh_path(spark, "idx")
    vectors = _vectors(spark, folder)
    _write_idx(with_position(vectors, "vec_id"), root)
    n = vectors.count()
    return idx.read_idx(spark, f"{root}/labels", "labels").where(F.col("pos").between(n // 3, n // 3 + n // 4))


@query(f"""
WITH {_BYTES}
SELECT CASE WHEN label < 7 THEN 'training' ELSE 'test' END AS split, count(DISTINCT vec_id) AS n, sum(v)::BIGINT AS total
FROM b GROUP BY ALL
""")
def convert_once(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed on the first call, read from the processed copy on the second."""
    root = fresh_path(spark, "convert")
    raw = {}
    for split, rows in (("training", F.col("label") < 7), ("test", F.col("label") >= 7)):
        _write_idx(with_position(_vectors(spark, folder).where(rows), "vec_id"), f"{root}/raw/{split}")
        raw[split] = (f"{root}/raw/{split}/images", f"{root}/raw/{split}/labels")
    idx.convert_once(spark, raw, f"{root}/processed")
    again = idx.convert_once(spark, raw, f"{root}/processed")
    pixels = again.select("split", F.flatten("image").alias("v"))
    total = F.aggregate("v", F.lit(0).cast("long"), lambda acc, v: acc + v)
    return pixels.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"))


def _split_column() -> Column:
    """Odd labels train, even ones test."""
    return F.when(F.pmod("label", F.lit(2)) == 1, "TRAIN").otherwise("TEST")


@query("""
WITH s AS (SELECT vec_id, label, CASE WHEN label % 2 = 1 THEN 'train' ELSE 'test' END AS split, embedding FROM embeddings),
k AS (SELECT * FROM s WHERE NOT (split = 'test' AND vec_id = (SELECT max(vec_id) FROM s WHERE split = 'test')))
SELECT split, label::DOUBLE AS label, count(*) AS n, min(len(embedding))::INTEGER AS width,
       round(sum(list_sum(list_transform(embedding, lambda v: floor(v::DOUBLE * 1000)))), 1) AS total
FROM k GROUP BY split, label
""")
def labelled_csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    root, name = fresh_path(spark, "labelled"), "Vectors"
    values = F.transform("x", lambda v: F.floor(v * 1000).cast("string"))
    line = F.concat_ws(",", F.col("label").cast("string"), values)
    lines = _vectors(spark, folder).select("vec_id", line.alias("value"), _split_column().alias("part"))
    for part in ("TRAIN", "TEST"):
        ordered = lines.where(F.col("part") == part).repartitionByRange("vec_id")
        ordered.sortWithinPartitions("vec_id").select("value").write.text(f"{root}/{name}/{name}_{part}")
    read = text.labelled_csv(spark, root, name)
    total = F.aggregate("series", F.lit(0.0), lambda acc, v: acc + v)
    return read.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("series")).alias("width"), rounded(F.sum(total), 1).alias("total")
    )


@query("""
WITH s AS (SELECT label, CASE WHEN label % 2 = 1 THEN 'train' ELSE 'test' END AS split,
           list_transform(embedding, lambda v: floor(v::DOUBLE * 1000)) AS x FROM embeddings)
SELECT split, 'c' || label AS label, t::INTEGER AS t, sum(x[t + 1]) AS ch0, sum(x[t + 33]) AS ch1, count(*) AS n
FROM s, generate_series(0, 31) g(t) GROUP BY ALL
""")
def ts_archive_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Two channels of 32 steps, written in the archive's line format."""
    root, kind, name = fresh_path(spark, "archive"), "Multivariate", "Vectors"
    values = F.transform("x", lambda v: F.floor(v * 1000).cast("string"))
    body = _vectors(spark, folder).select(
        _split_column().alias("part"),
        F.concat_ws(
            ":",
            F.concat_ws(",", F.slice(values, 1, 32)),
            F.concat_ws(",", F.slice(values, 33, 32)),
            F.concat(F.lit("c"), F.col("label").cast("string")),
        ).alias("value"),
    )
    head = spark.createDataFrame([("# two channels",), ("@timeStamps false",), ("@data",)], "value STRING")
    for train in (True, False):
        part = body.where(F.col("part") == ("TRAIN" if train else "TEST")).select("value")
        head.coalesce(1).unionByName(part).write.text(text.ts_archive_path(root, kind, name, train))
    read = text.ts_archive(spark, root, kind, name)
    steps = read.select("split", "label", F.posexplode("series").alias("t", "c"))
    return steps.groupBy("split", "label", "t").agg(
        F.sum(F.get("c", 0)).alias("ch0"), F.sum(F.get("c", 1)).alias("ch1"), F.count(F.lit(1)).alias("n")
    )


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_totalprice AS value FROM orders")
def series_csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "series")
    order = ["o_orderdate", "o_orderkey"]
    (
        table(spark, folder, "orders")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("o_orderkey", F.col("o_totalprice").alias("passengers"))
        .write.option("header", True)
        .csv(path)
    )
    return text.series_csv(spark, path, "passengers")


@query("""
WITH c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS ix FROM (SELECT DISTINCT p_type FROM part) t)
SELECT DISTINCT CASE WHEN p_size <= 40 THEN 'train' ELSE 'val' END AS split, p_type AS class, ix::INTEGER AS class_ix
FROM part JOIN c USING (p_type)
""")
def class_dirs(spark: SparkSession, folder: str) -> DataFrame:
    """A ``{split}/{class}/{file}`` tree; Spark writes its folders as key=value."""
    root = fresh_path(spark, "classes")
    (
        table(spark, folder, "part")
        .select(
            F.when(F.col("p_size") <= 40, "train").otherwise("val").alias("split"),
            F.col("p_type").alias("class"),
            F.col("p_name").alias("value"),
        )
        .write.partitionBy("split", "class")
        .text(root)
    )
    found = files.class_folders(spark, root, train="split=train")
    bare = [F.regexp_replace(c, "^[a-z]+=", "").alias(c) for c in ("split", "class")]
    return found.select(*bare, "class_ix").distinct()


@query("SELECT DISTINCT 'source=' || source AS dataset FROM documents")
def archive_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    root = fresh_path(spark, "catalogue")
    table(spark, folder, "documents").select("source", "n_chars").write.partitionBy("source").parquet(root)
    return files.archive_datasets(spark, root)


_METRIC_SQL = """
WITH m AS (SELECT event_type AS run, CASE WHEN hour(ts) < 16 THEN 'training' ELSE 'validation' END AS phase,
                  date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS epoch, round(sqrt(avg(power(value - 50, 2))), 6) AS loss, max(value) AS peak FROM events GROUP BY ALL)
"""


@query(f"{_METRIC_SQL} SELECT run || '-' || phase AS phase, epoch, loss, peak FROM m")
def metric_log_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Two appends (early and late epochs) to the same wide log, read back."""
    root = fresh_path(spark, "metric-log")
    rows = _metric_rows(spark, folder).withColumn("phase", F.concat_ws("-", "run", "phase"))
    for part in (rows.where(F.col("epoch") <= 15), rows.where(F.col("epoch") > 15)):
        sinks.append_metrics(part, ["loss", "peak"], root)
    return sinks.read_metrics(spark, ["loss", "peak"], root).select("phase", "epoch", "loss", "peak")


@query("""
SELECT 'test' AS phase, label AS epoch, count(*) AS n, round(sum(v), 4) AS v, round(sum(v * v), 4) AS pair_1
FROM (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) e GROUP BY label
""")
def history_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    root = fresh_path(spark, "history")
    histories = _vectors(spark, folder).select(
        F.lit("test").alias("phase"),
        F.col("label").alias("epoch"),
        F.col("x").alias("v"),
        F.transform("x", lambda v: F.array(F.lit(1.0), v * v)).alias("pair"),
    )
    sinks.write_history(histories, {"v": None, "pair": 2}, root)
    columns = "ix INT, v DOUBLE, pair_0 DOUBLE, pair_1 DOUBLE, phase STRING, epoch INT"
    back = spark.read.schema(columns).option("header", True).csv(f"{root}/history")
    return back.groupBy("phase", "epoch").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("v"), 4).alias("v"), rounded(F.sum("pair_1"), 4).alias("pair_1")
    )


@query("SELECT event_type AS text, event_id::VARCHAR AS event_id, value::VARCHAR AS value FROM events")
def text_log_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    root = fresh_path(spark, "text-log")
    rows = table(spark, folder, "events").select(
        F.col("event_type").alias("text"), F.col("ts").alias("timestamp"), "event_id", "value"
    )
    sinks.append_text(rows, root)
    back = spark.read.schema("text STRING, timestamp STRING, extra MAP<STRING, STRING>").json(f"{root}/text")
    return back.select("text", *[F.col("extra")[k].alias(k) for k in ("event_id", "value")])


@query("""
SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity) - 1 AS pos,
       l_quantity AS prediction, l_linenumber AS target FROM lineitem
""")
def prediction_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions written in order of their rows and read back with their positions."""
    root = fresh_path(spark, "predictions")
    rows = table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("prediction"), F.col("l_linenumber").alias("target"), "l_shipdate", "l_orderkey"
    )
    written = sinks.write_predictions(rows, root, order_by=["l_shipdate", "l_orderkey", "target", "prediction"], file_rows=7_000)
    return sinks.read_predictions(spark, written, "prediction DOUBLE, target INT")


@query("""
WITH p AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_totalprice AS prediction,
                  o_orderkey AS target, count(*) OVER () AS n FROM orders)
SELECT pos, prediction, target FROM p WHERE pos >= n // 2 AND pos < n // 2 + n // 5
""")
def predictions_from_the_middle(spark: SparkSession, folder: str) -> DataFrame:
    """A fifth of an ordered prediction table, read from its middle on."""
    root = fresh_path(spark, "predictions")
    rows = table(spark, folder, "orders").select(
        F.col("o_totalprice").alias("prediction"), F.col("o_orderkey").alias("target"), "o_orderdate"
    )
    n = rows.count()
    written = sinks.write_predictions(rows, root, order_by=["o_orderdate", "target"], file_rows=1_000)
    return sinks.read_predictions(spark, written, "prediction DOUBLE, target LONG", n // 2, n // 5)


@query("SELECT c_custkey, c_mktsegment FROM customer")
def keyed_table_dump(spark: SparkSession, folder: str) -> DataFrame:
    root = fresh_path(spark, "dump")
    sinks.write_table(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "customers", root)
    return spark.read.schema("c_custkey LONG, c_mktsegment STRING").option("header", True).csv(f"{root}/customers")


@query("""
SELECT 'rows' AS sink, count(*) AS n FROM events UNION ALL SELECT 'types', count(DISTINCT event_type) FROM events
""")
def fan_out_sinks(spark: SparkSession, folder: str) -> DataFrame:
    root = fresh_path(spark, "fan-out")
    sinks.fan_out(
        table(spark, folder, "events").select("event_id", "event_type"),
        [
            lambda df: df.write.parquet(f"{root}/rows"),
            lambda df: df.groupBy("event_type").count().write.json(f"{root}/types"),
        ],
    )
    counts = [
        spark.read.parquet(f"{root}/rows").agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("sink"), "n"),
        spark.read.schema("event_type STRING").json(f"{root}/types").agg(
            F.count(F.lit(1)).alias("n")
        ).select(F.lit("types").alias("sink"), "n"),
    ]
    return counts[0].unionByName(counts[1])


@query("SELECT source AS stem, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source")
def convert_by_stem(spark: SparkSession, folder: str) -> DataFrame:
    """One CSV folder per source file; the file is named by the ``source`` path."""
    root = fresh_path(spark, "stems")
    docs = table(spark, folder, "documents").select(
        "doc_id", "n_chars", F.concat(F.lit("raw/"), "source", F.lit(".bin")).alias("path")
    )
    sinks.convert_by_stem(docs, "path", root)
    back = spark.read.schema("doc_id LONG, n_chars LONG, stem STRING").option("header", True).csv(root)
    return back.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@query("""
SELECT event_type AS run, 'adam' AS optimizer, '32' AS batch_size, count(*)::VARCHAR AS n_rows FROM events GROUP BY event_type
""")
def run_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Parameter maps of runs, hyper-parameters overriding parameters."""
    runs = table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    base = F.create_map(
        F.lit("optimizer"), F.lit("sgd"), F.lit("batch_size"), F.lit("32"), F.lit("n_rows"), F.col("n").cast("string")
    )
    merged = runs.select(
        "event_type", merge_maps(base, F.create_map(F.lit("optimizer"), F.lit("adam"))).alias("p")
    )
    return merged.select(
        F.col("event_type").alias("run"), *[F.col("p")[k].alias(k) for k in ("optimizer", "batch_size", "n_rows")]
    )


@query("""
SELECT count(*) AS first_rows, true AS refused, max(event_id) AS last_rows, count(DISTINCT user_id) AS users FROM events
""")
def run_record(spark: SparkSession, folder: str) -> DataFrame:
    """A run record written, refused for an existing run, and overridden by a debug run."""
    root = fresh_path(spark, "run-record")
    counts = table(spark, folder, "events").agg(
        F.count(F.lit(1)).alias("rows"), F.max("event_id").alias("last"), F.count_distinct("user_id").alias("users")
    ).first()
    params = {"rows": counts["rows"], "users": counts["users"]}
    schema = "rows STRING, users STRING"

    def recorded() -> DataFrame:
        return spark.read.text(f"{root}/params").select(F.from_json("value", schema).alias("p")).select("p.*")

    sinks.write_parameters(spark, root, params, {})
    first = recorded().first()["rows"]
    try:
        sinks.write_parameters(spark, root, params, {"rows": 0})
        refused = False
    except AnalysisException:
        refused = True
    sinks.write_parameters(spark, root, params, {"rows": counts["last"]}, project="debug")
    return recorded().select(
        F.lit(first).cast("long").alias("first_rows"), F.lit(refused).alias("refused"),
        F.col("rows").cast("long").alias("last_rows"), F.col("users").cast("long").alias("users"),
    )


@query("""
SELECT event_type AS run, 'training' AS phase, user_id::INTEGER AS epoch, 'value' AS metric, value::DOUBLE AS value FROM events
""")
def metric_log_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Metric events as CSV, read back with the declared schema."""
    path = fresh_path(spark, "metric-events")
    events = table(spark, folder, "events").select(
        F.col("event_type").alias("run"), F.lit("training").alias("phase"), F.col("user_id").cast("int").alias("epoch"),
        F.lit("value").alias("metric"), F.col("value").cast("double").alias("value"), F.col("ts").cast("timestamp").alias("ts"),
    )
    events.write.option("header", True).csv(path)
    return text.metric_log(spark, path).drop("ts")
