"""Line-oriented sources: labelled series, series archives, single columns, logs.

All of them are splittable text scans; ``line_order`` columns say where a line
stood, since rows themselves have no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.functions.arrays import transpose
from stridemill.operators.order import with_position
from stridemill.schema import METRIC_EVENT
from stridemill.session import stage

# A total order of the lines of a scan: file, start of the split, line in the split.
LINE_ORDER = ["file", "block", "line"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines with their place. Row ids grow along a split of a file;
    another scan may be split differently, so the place orders the lines of one
    scan and is no key between scans."""
    return (
        spark.read.text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        )
        .where(F.trim("value") != "")
    )


def _both_splits(spark: SparkSession, train: str, test: str) -> DataFrame:
    return (
        read_lines(spark, train)
        .withColumn("split", F.lit("train"))
        .unionByName(read_lines(spark, test).withColumn("split", F.lit("test")))
    )


def labelled_csv(
    spark: SparkSession, root: str, name: str, drop_last_test_row: bool = True
) -> DataFrame:
    """``<root>/<name>/<name>_TRAIN`` and ``_TEST``: label first, then the values.

    The last test line is left out unless told otherwise. Returns
    ``(split, label, series)`` and the line order.
    """
    base = f"{root.rstrip('/')}/{name}/{name}"
    test = read_lines(spark, f"{base}_TEST")
    if drop_last_test_row:
        # written once: the place of a line may differ between two scans
        test = stage(test, "test-lines")
        place = F.struct(*LINE_ORDER)
        test = test.where(place != test.agg(F.max(place).alias("last")).scalar())
    lines = (
        read_lines(spark, f"{base}_TRAIN")
        .withColumn("split", F.lit("train"))
        .unionByName(test.withColumn("split", F.lit("test")))
    )
    values = F.transform(F.split("value", ","), lambda v: F.trim(v).cast("double"))
    return lines.withColumn("v", values).select(
        "split",
        F.get("v", 0).alias("label"),
        F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))).alias("series"),
        *LINE_ORDER,
    )


def ts_archive_path(root: str, kind: str, name: str, train: bool) -> str:
    return f"{root.rstrip('/')}/{kind}/{name}/{name}_{'TRAIN' if train else 'TEST'}.ts"


def _channel(text: Column) -> Column:
    return F.transform(
        F.split(text, ","),
        lambda v: F.when(F.trim(v) == "?", F.lit(float("nan"))).otherwise(F.trim(v).cast("double")),
    )


def ts_archive(spark: SparkSession, root: str, kind: str, name: str) -> DataFrame:
    """Both splits of an archive data set: ``(split, series, label)``, line order.

    ``series`` is time x channel. Header lines start with ``@`` or ``#``;
    channels are separated by ``:``, values by ``,`` and the label comes last.
    ``?`` is a missing value (NaN). Series with time stamps are refused.
    """
    lines = _both_splits(
        spark, ts_archive_path(root, kind, name, True), ts_archive_path(root, kind, name, False)
    )
    stamped = F.lower(F.col("value")).rlike(r"^\s*@timestamps\s+true") | F.col("value").rlike(r"^\s*\(")
    data = lines.where(stamped | ~F.col("value").rlike(r"^\s*[@#]")).withColumn(
        "fields",
        F.when(stamped, F.raise_error(F.lit("series with time stamps are not supported"))).otherwise(
            F.split("value", ":")
        ),
    )
    channels = F.transform(F.slice("fields", 1, F.size("fields") - 1), _channel)
    return data.select(
        "split",
        transpose(channels).alias("series"),
        F.trim(F.element_at("fields", -1)).alias("label"),
        *LINE_ORDER,
    )


def series_csv(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One numeric column of a CSV with a header, as ``(pos, value)``."""
    header = spark.read.option("header", True).csv(path)
    if column not in header.columns:
        raise ValueError(f"no column {column} in {path}; have {header.columns}")
    rows = header.select(
        F.col(column).cast("double").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return with_position(rows, LINE_ORDER).select("pos", "value")


def metric_log(spark: SparkSession, path: str, schema: str = METRIC_EVENT) -> DataFrame:
    """Read metric CSVs back with a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).csv(path)
