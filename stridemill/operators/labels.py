"""Label encoding and class counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridemill.operators.order import with_position
from stridemill.schema import require_array, require_columns, require_numeric
from stridemill.session import stage

# Class tables up to this many rows are broadcast, larger ones joined by shuffle.
SMALL_CLASSES = 100_000


def zero_base_labels(
    df: DataFrame, label: str, split: str = "split", train: str = "train"
) -> DataFrame:
    """Subtract the smallest training label from all labels."""
    require_numeric(df, label)
    require_columns(df, split)
    base = df.where(F.col(split) == train).agg(F.min(label)).first()[0]
    if base is None:
        raise ValueError("no training label")
    return df.withColumn(label, F.col(label) - F.lit(base))


def class_table(
    df: DataFrame, label: str, split: str | None = "split", train: str = "train"
) -> tuple[DataFrame, bool]:
    """Sorted distinct training labels numbered from 0, and whether they are few.

    The labels are written once, so that counting them reads no rows again.
    """
    require_columns(df, label)
    rows = df.where(F.col(split) == train) if split else df
    labels = stage(rows.select(label).where(F.col(label).isNotNull()).distinct(), "classes")
    few = labels.count() <= SMALL_CLASSES
    if few:
        number = F.row_number().over(Window.orderBy(label)).cast("long") - 1
        return labels.withColumn("class_id", number), True
    return with_position(labels, label, pos="class_id"), False


def encode_classes(
    df: DataFrame,
    label: str,
    split: str | None = "split",
    train: str = "train",
    handle_unseen: str = "error",
) -> DataFrame:
    """Add ``class_id``; a label not among the training labels is an error or NULL."""
    if handle_unseen not in ("error", "null"):
        raise ValueError("handle_unseen must be 'error' or 'null'")
    table, few = class_table(df, label, split, train)
    joined = df.join(F.broadcast(table) if few else table, label, "left")
    if handle_unseen == "null":
        return joined
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.col(label).cast("string")))
    return joined.withColumn(
        "class_id",
        F.when(F.col("class_id").isNull() & F.col(label).isNotNull(), unseen.cast("long")).otherwise(
            F.col("class_id")
        ),
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    require_columns(df, label)
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def shape_summary(df: DataFrame, label: str, series: str) -> DataFrame:
    """One row: number of classes, of channels and of rows.

    ``series`` is time x channel; channel counts that differ show as a range.
    """
    require_columns(df, label)
    require_array(df, series)
    channels = F.size(F.get(series, 0))
    return df.agg(
        F.countDistinct(label).alias("n_classes"),
        F.min(channels).alias("min_channels"),
        F.max(channels).alias("max_channels"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def as_samples(df: DataFrame, data: str, target: str | None = None) -> DataFrame:
    """``(data, target)``; without a target the data is its own target."""
    require_columns(df, data, *([target] if target else []))
    others = [c for c in df.columns if c not in (data, target)]
    return df.select(*others, F.col(data).alias("data"), F.col(target or data).alias("target"))
