"""Series cut into samples: look-ahead, sliding and hopping windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stridemill.operators.order import Hot, frames
from stridemill.schema import ColumnLike, col, names, require_columns, require_numeric


def lookahead_samples(
    df: DataFrame,
    value: str,
    seq_len: int,
    look_ahead: int,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] = (),
    carry: Sequence[str] = (),
    max_group_rows: int | None = None,
    chunk_rows: int | None = None,
    hot: Hot = None,
) -> DataFrame:
    """``x = v[i : i+seq_len]``, ``target = v[i+seq_len+look_ahead-1]``.

    A series of N values gives ``N - seq_len - look_ahead + 1`` samples, NULL
    values included. ``carry`` columns come from the target's row; ``hot`` are
    hot keys that are known already (``order.split_hot``).
    """
    if seq_len < 1 or look_ahead < 0:
        raise ValueError("seq_len must be at least 1 and look_ahead not negative")
    require_numeric(df, value)
    require_columns(df, *carry)
    return frames(
        df,
        F.col(value).cast("double"),
        seq_len,
        seq_len + look_ahead - 1,
        order_by,
        partition_by,
        [F.col(value).cast("double").alias("target"), *[F.col(c) for c in carry]],
        max_group_rows=max_group_rows,
        chunk_rows=chunk_rows,
        hot=hot,
    )


def sliding_windows(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    window: int,
    stride: int = 1,
    time: str | None = None,
    order_by: str | Sequence[str] = (),
    partition_by: str | Sequence[str] = (),
    max_group_rows: int | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Window matrices of the features with the last row's label and time.

    ``start`` is the position of the first row. A series of N rows gives
    ``floor((N - window) / stride) + 1`` windows, none if it is shorter.
    """
    if window < 1 or stride < 1:
        raise ValueError("window and stride must be at least 1")
    order = names(order_by) or ([time] if time else [])
    if not order:
        raise ValueError("give order_by or time")
    require_numeric(df, *features)
    require_columns(df, label)
    tail = [F.col(label).alias("label")] + ([F.col(time).alias("ts")] if time else [])
    matrix = F.array(*[F.col(f).cast("double") for f in features])
    rows = frames(
        df, matrix, window, window - 1, order, partition_by, tail, stride, max_group_rows, chunk_rows, row_bytes=8 * len(features)
    )
    return rows.withColumnRenamed("pos", "start")


@dataclass(frozen=True)
class SliceGrid:
    """Slices ``[t0 + k*stride, t0 + k*stride + length)`` for k in 0..count-1."""

    t0: float
    length: float
    stride: float
    count: int

    @staticmethod
    def fit(
        df: DataFrame,
        time: ColumnLike,
        length: float = 1,
        stride: float | None = None,
        start: float | None = None,
        end: float | None = None,
    ) -> SliceGrid:
        """From the first and last time (one aggregate row) unless given."""
        stride = length if stride is None else stride
        if length <= 0 or stride <= 0:
            raise ValueError("length and stride must be positive")
        if start is None or end is None:
            low, high = df.agg(F.min(col(time)), F.max(col(time))).first()
            start = low if start is None else start
            end = high if end is None else end
        if start is None or end is None:
            return SliceGrid(0, length, stride, 0)
        count = max(0, -((-(end - length + stride - start)) // stride))
        return SliceGrid(start, length, stride, int(count))

    def ordinals(self, time: Column) -> Column:
        """The slices that hold a time, as an array (empty in a gap)."""
        since = time - F.lit(self.t0)
        # the division may round across an edge: one more slice on each side, then the edges decide
        last = F.least(F.floor(since / F.lit(self.stride)) + 1, F.lit(self.count - 1))
        first = F.greatest(F.floor((since - F.lit(self.length)) / F.lit(self.stride)), F.lit(0))

        def holds(k: Column) -> Column:
            start = F.lit(self.t0) + k * F.lit(self.stride)
            return (start <= time) & (time < start + F.lit(self.length))

        return F.when(first <= last, F.filter(F.sequence(first, last), holds)).otherwise(
            F.array().cast("array<bigint>")
        )


def assign_slices(df: DataFrame, time: ColumnLike, grid: SliceGrid, slice_col: str = "slice") -> DataFrame:
    """One row per (row, slice that holds it)."""
    return df.withColumn(slice_col, F.explode(grid.ordinals(col(time))))


def _passed(time: Column, grid: SliceGrid, ends: bool) -> Column:
    """How many slices of an endless grid have begun, or with ``ends`` have ended, at or before a time.

    Division gives the number up to one; the edges next to it are compared as
    ``ordinals`` computes them.
    """
    t0, stride, length = F.lit(grid.t0), F.lit(grid.stride), F.lit(grid.length)
    since = time - t0 - length if ends else time - t0
    low = F.greatest(F.floor(since / stride).cast("long") - 1, F.lit(0).cast("long"))
    out = low
    for i in range(4):
        edge = t0 + (low + i) * stride
        out = out + ((edge + length if ends else edge) <= time).cast("long")
    return out


def slice_summary(
    df: DataFrame, time: ColumnLike, value: str, grid: SliceGrid, slice_col: str = "slice"
) -> DataFrame:
    """Count, sum, minimum and maximum per slice, for whole or fractional grids; rows are not copied.

    All slice edges cut the axis into elementary intervals: a row's is told by
    how many slices have begun (``a``) and ended (``b``) by its time, and it
    belongs to the slices ``b`` to ``a - 1``. Rows are folded per interval,
    before the shuffle. Intervals are put in blocks, each from one start to the
    ``m``-th next, where ``m`` is one less than the number of strides in a
    length. A slice is then the end of the block it begins in and the beginnings
    of at most three blocks behind it, so running values from both ends of each
    block give all slices, with a few rows for each; nothing is subtracted, so
    sums lose no digits. Times may be null or NaN (in no slice).
    """
    require_columns(df, value)
    m = max(1, int(grid.length // grid.stride) - 1) if grid.count else 1
    t = col(time)
    inside = t.isNotNull() & ~F.isnan(t.cast("double"))
    rows = df.where(inside).select(
        _passed(t, grid, False).alias("a"), _passed(t, grid, True).alias("b"), F.col(value).alias("v")
    )
    state = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")]
    intervals = (
        rows.where((F.col("b") < F.col("a")) & (F.col("b") < grid.count))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
        .withColumn("block", F.floor((F.col("a") - 1) / m))
    )
    along = Window.partitionBy("block").orderBy("a", "b")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = along.rowsBetween(Window.currentRow, Window.unboundedFollowing)

    def running(spec: WindowSpec) -> Column:
        return F.struct(
            F.sum("n").over(spec).alias("n"), F.sum("total").over(spec).alias("total"),
            F.min("low").over(spec).alias("low"), F.max("high").over(spec).alias("high"),
        )

    placed = intervals.select(
        "a", "b", "block", F.lead("b").over(along).alias("next_b"), F.lag("a").over(along).alias("last_a"),
        running(upto).alias("upto"), running(beyond).alias("beyond"),
    )
    first = F.col("block") * m
    # slices that began before this block (at its edge, if blocks have one start) and end behind this interval
    last = first if m == 1 else first - 1
    to = F.least(F.coalesce(F.col("next_b") - 1, last), last)
    parts = [F.struct(F.col("b").alias("low"), to.alias("high"), F.col("upto").alias("s"))]
    if m > 1:  # slices that begin in this block, at the interval or after the one before it
        begun = F.greatest(F.coalesce("last_a", first), first)
        parts.append(F.struct(begun.alias("low"), (F.col("a") - 1).alias("high"), F.col("beyond").alias("s")))
    pieces = placed.select(F.explode(F.array(*parts)).alias("p")).where(F.col("p.low") <= F.col("p.high"))
    slices = pieces.select(F.explode(F.sequence("p.low", "p.high")).alias(slice_col), "p.s.*")
    return slices.where(F.col(slice_col) < grid.count).groupBy(slice_col).agg(*state)
