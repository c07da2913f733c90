"""Writers for metrics, histories, text, predictions and run parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridemill.functions.scalars import file_stem
from stridemill.operators.order import rank_globally
from stridemill.operators.runlog import history_rows, metrics_wide, run_parameters
from stridemill.schema import names, require_columns

# Rows of a file of ordered predictions, tasks that write them at most, and what their manifest says.
FILE_ROWS = 1_000_000
MOST_TASKS = 100_000
MANIFEST = "n_rows LONG, file_rows LONG"


def append_metrics(events: DataFrame, metrics: Sequence[str], root: str) -> None:
    """Wide metric rows appended as CSV, one folder per phase."""
    wide = metrics_wide(events, metrics)
    wide.write.mode("append").partitionBy("phase").option("header", True).csv(f"{root}/metric")


def read_metrics(spark: SparkSession, metrics: Sequence[str], root: str) -> DataFrame:
    columns = ", ".join(["epoch INT", *[f"`{m}` DOUBLE" for m in metrics], "phase STRING"])
    return spark.read.schema(columns).option("header", True).csv(f"{root}/metric")


def write_history(df: DataFrame, widths: Mapping[str, int | None], root: str) -> None:
    """Element rows of histories, one folder per phase and epoch."""
    rows = history_rows(df, ["phase", "epoch"], widths)
    rows.write.mode("append").partitionBy("phase", "epoch").option("header", True).csv(f"{root}/history")


def append_text(df: DataFrame, root: str) -> None:
    """Free-text rows ``(text, timestamp)``; all other columns become ``extra``."""
    require_columns(df, "text", "timestamp")
    others = [c for c in df.columns if c not in ("text", "timestamp")]
    pairs = [v for c in others for v in (F.lit(c), F.col(c).cast("string"))]
    extra = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    df.select("text", "timestamp", extra.alias("extra")).write.mode("append").json(f"{root}/text")


def write_table(df: DataFrame, key: str, root: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(f"{root}/{key}")


def write_predictions(
    df: DataFrame,
    root: str,
    path: str | None = None,
    order_by: str | Sequence[str] = (),
    file_rows: int = FILE_ROWS,
) -> str:
    """``(prediction, target)`` as CSV under the run, or at a given path.

    With ``order_by`` (a total order) the rows keep their order: every file
    holds the next ``file_rows`` rows in order, in a folder named by its number,
    and a manifest says how many rows there are in all and in a file, so that
    ``read_predictions`` can begin at any position. The manifest is written
    last.
    """
    require_columns(df, "prediction", "target")
    target = path or f"{root}/predictions"
    if not names(order_by):
        df.select("prediction", "target").write.mode("overwrite").option("header", True).csv(target)
        return target
    if file_rows < 1:
        raise ValueError("file_rows must be at least 1")
    narrow = df.select(*dict.fromkeys([*names(order_by), "prediction", "target"]))
    ranked = rank_globally(narrow, order_by)
    blocks = ranked.df.select("prediction", "target", "pos", F.floor(F.col("pos") / file_rows).alias("block"))
    tasks = max(1, -(-ranked.total // file_rows))
    (
        blocks.repartition(min(tasks, MOST_TASKS), "block")
        .sortWithinPartitions("block", "pos")
        .drop("pos")
        .write.mode("overwrite")
        .partitionBy("block")
        .option("header", True)
        .csv(target)
    )
    facts = [(ranked.total, file_rows)]
    df.sparkSession.createDataFrame(facts, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{target}/_manifest")
    return target


def read_predictions(
    spark: SparkSession, path: str, schema: str = "prediction DOUBLE, target DOUBLE", first: int = 0, rows: int | None = None
) -> DataFrame:
    """``pos`` and the columns of an ordered prediction table, from any position on.

    Only the files that hold the wanted positions are read. A line's position
    follows from its file's number and its place in the file.
    """
    total, size = spark.read.schema(MANIFEST).json(f"{path}/_manifest").select("n_rows", "file_rows").first()
    first, last = max(0, first), total if rows is None else min(total, first + rows)
    lines = (
        spark.read.schema(f"{schema}, block LONG").option("header", True).csv(path)
        .where(F.col("block").between(first // size, max(first, last - 1) // size))
        .withColumns({"__start": F.col("_metadata.file_block_start"), "__line": F.monotonically_increasing_id()})
    )
    place = F.row_number().over(Window.partitionBy("block").orderBy("__start", "__line")) - 1
    placed = lines.withColumn("pos", F.col("block") * size + place).drop("__start", "__line", "block")
    others = [c for c in placed.columns if c != "pos"]
    return placed.where((F.col("pos") >= first) & (F.col("pos") < last)).select("pos", *others)


def write_parameters(
    spark: SparkSession,
    root: str,
    params: Mapping[str, object],
    hyperparams: Mapping[str, object],
    project: str = "",
) -> None:
    """Record a run. An existing run is refused (Spark's ``errorifexists``)
    unless it is a debug project, pretrained or resumed."""
    known = project == "debug" or bool(params.get("pretrained")) or bool(params.get("resume"))
    rows = run_parameters(spark, params, hyperparams).select(F.to_json("params").alias("value"))
    rows.write.mode("overwrite" if known else "errorifexists").text(f"{root}/params")


def fan_out(df: DataFrame, sinks: Sequence[Callable[[DataFrame], None]]) -> None:
    """Compute once, write to several sinks."""
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        for sink in sinks:
            sink(kept)
    finally:
        kept.unpersist()


def convert_by_stem(df: DataFrame, source_path: str, target: str) -> None:
    """One output folder per input file, named after the file's stem."""
    require_columns(df, *names(source_path))
    stemmed = df.withColumn("stem", file_stem(source_path)).drop(source_path)
    stemmed.write.mode("overwrite").partitionBy("stem").option("header", True).csv(target)
