"""Listings of file trees; only paths are read, never file contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.operators.labels import encode_classes


def list_paths(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``; the content column is pruned from the scan."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    )


def _below(root: str) -> Column:
    """The part of the path after the root folder, whatever the scheme."""
    tail = root.rstrip("/").split("://")[-1].split(":", 1)[-1]
    return F.substring_index(F.col("path"), f"{tail}/", -1)


def archive_datasets(spark: SparkSession, root: str) -> DataFrame:
    """Names of the folders directly below an archive root that hold files."""
    below = _below(root)
    return (
        list_paths(spark, root)
        .where(F.contains(below, F.lit("/")))
        .select(F.substring_index(below, "/", 1).alias("dataset"))
        .distinct()
    )


def class_folders(spark: SparkSession, root: str, train: str = "train") -> DataFrame:
    """``{split}/{class}/{file}`` trees: ``(path, split, class, class_ix)``.

    The index is the rank of the class name among the training classes.
    """
    parts = F.split(_below(root), "/")
    files = (
        list_paths(spark, root)
        .where(F.size(parts) == 3)
        .select("path", F.get(parts, 0).alias("split"), F.get(parts, 1).alias("class"))
    )
    return (
        encode_classes(files, "class", "split", train)
        .withColumn("class_ix", F.col("class_id").cast("int"))
        .select("path", "split", "class", "class_ix")
    )
