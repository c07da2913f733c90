"""Ordered train/test splits of exact size, and batches of positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemill.functions.arrays import pad_to
from stridemill.operators.order import Hot, with_position
from stridemill.operators.sampling import hash_position
from stridemill.operators.selection import label_first
from stridemill.schema import names, require_array, require_columns

DEFAULT_BATCH = 16


def _label(train: Column) -> Column:
    return F.when(train, "train").otherwise("test")


def ordered_split(
    df: DataFrame,
    ratio: float,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] = (),
    column: str = "split",
    max_group_rows: int | None = None,
) -> DataFrame:
    """The first ``int(ratio * n)`` rows are training rows, per series if keyed.

    Without a key the first test row is looked for by counting, and the table
    is labelled by comparison with it; nothing is sorted. Rows with equal order
    values are then taken in order of their other columns, so the size is exact
    on any table (``selection.label_first``).
    """
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be between 0 and 1")
    keys, order = names(partition_by), names(order_by)
    require_columns(df, *keys, *order)
    if not keys:
        total = df.count()
        return label_first(df, int(ratio * total), order, column, total)
    placed = with_position(df, order, keys, "__pos", "__total", max_group_rows)
    size = F.floor(F.lit(float(ratio)) * F.col("__total"))
    return placed.withColumn(column, _label(F.col("__pos") < size)).drop("__pos", "__total")


def fixed_split(
    df: DataFrame,
    n_train: int,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] = (),
    column: str = "split",
    max_group_rows: int | None = None,
    hot: Hot = None,
) -> DataFrame:
    """The first ``n_train`` rows (of each series) are training rows; ties as in ``ordered_split``."""
    keys, order = names(partition_by), names(order_by)
    require_columns(df, *keys, *order)
    if not keys:
        return label_first(df, n_train, order, column)
    placed = with_position(df, order, keys, "__pos", None, max_group_rows, hot)
    return placed.withColumn(column, _label(F.col("__pos") < n_train)).drop("__pos")


def _batch(df: DataFrame, size: int, drop_last: bool) -> DataFrame:
    if size < 1:
        raise ValueError("batch size must be at least 1")
    out = df.withColumn("batch_ix", F.floor(F.col("pos") / size))
    if drop_last:
        out = out.where(F.col("batch_ix") < F.floor(F.col("__total") / size))
    return out.drop("__total")


def batches(
    df: DataFrame,
    order_by: str | Sequence[str],
    size: int = DEFAULT_BATCH,
    partition_by: str | Sequence[str] = (),
    drop_last: bool = False,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Add ``pos`` and ``batch_ix``; ``partition_by`` numbers each loader on its own."""
    placed = with_position(df, order_by, partition_by, "pos", "__total", max_group_rows)
    return _batch(placed, size, drop_last)


def ordered_batches(
    df: DataFrame, order_by: str | Sequence[str], size: int = DEFAULT_BATCH, columns: Sequence[str] = ()
) -> DataFrame:
    """One row per batch of consecutive rows: ``batch_ix`` and each column as an array in order.

    For callers that go through scored rows in order, for instance by
    ``toLocalIterator`` over the sorted batches; only the last batch is short.
    """
    columns = list(columns) or df.columns
    placed = batches(df, order_by, size)
    rows = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    out = placed.groupBy("batch_ix").agg(rows.alias("__rows"))
    return out.select("batch_ix", *[F.col(f"__rows.{c}").alias(c) for c in columns])


def shuffled_batches(
    df: DataFrame,
    ids: str | Sequence[str],
    size: int = DEFAULT_BATCH,
    seed: int = 0,
    epoch: int = 0,
    drop_last: bool = False,
) -> DataFrame:
    """Batches of a pseudo-random order that differs per seed and epoch."""
    return _batch(hash_position(df, ids, seed, epoch, total="__total"), size, drop_last)


def pad_batches(df: DataFrame, x: str, batch: str | Sequence[str] = "batch_ix") -> DataFrame:
    """Zero-pad ``x`` to the longest of its batch and keep its length in ``len``.

    A batch has as many rows as the batch size says, so it is gathered: the
    arrays move once.
    """
    keys = names(batch)
    require_columns(df, *keys)
    require_array(df, x)
    longest = F.max(F.size(x)).over(Window.partitionBy(*keys))
    return (
        df.withColumn("__longest", longest)
        .withColumn("len", F.size(x))
        .withColumn(x, pad_to(F.col(x).cast("array<double>"), "__longest"))
        .drop("__longest")
    )


def padded_batches(
    df: DataFrame,
    x: str | Column,
    id: str,
    size: int = DEFAULT_BATCH,
    order_by: str | Sequence[str] = (),
    length: Column | None = None,
    name: str | None = None,
) -> DataFrame:
    """``batches`` and ``pad_batches`` of rows with a unique ``id`` (the order, unless given).

    ``x`` is an array column, or an expression that makes one (named ``name``).
    Positions and longest lengths come from ids and lengths alone (``length``,
    if it is cheaper to tell than ``x``); the rows are moved once, to meet them,
    and arrays are made and padded where they arrive.
    """
    order = names(order_by) or [id]
    require_columns(df, id, *order)
    if isinstance(x, str):
        require_array(df, x)
        name, x = x, F.col(x)
    if name is None:
        raise ValueError("give a name to the padded array")
    narrow = df.select(*dict.fromkeys([id, *order]), (F.size(x) if length is None else length).alias("__n"))
    placed = batches(narrow, order, size)
    placed = placed.withColumn("__longest", F.max("__n").over(Window.partitionBy("batch_ix")))
    placed = placed.select(F.col(id).alias("__id"), "pos", "batch_ix", F.col("__n").alias("len"), "__longest")
    fill = F.array_repeat(F.lit(0.0), F.col("__longest") - F.col("len"))
    return (
        df.join(placed, F.col(id).eqNullSafe(F.col("__id")))
        .withColumn(name, F.concat(x.cast("array<double>"), fill))
        .drop("__longest", "__id")
    )
