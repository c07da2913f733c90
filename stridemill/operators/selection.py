"""Exact selection in an order: the first rows of a table, without sorting or moving it.

The row at a rank is found by refinement: a bounded sample gives border keys
around the place where the rank should be, one aggregate counts the rows
between them, and the search goes on between the two borders that hold it. A
border that stands for many equal rows is a range of its own, so ties end the
search instead of prolonging it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridemill.session import stage

# Keys that are sampled in a round, on average, and borders chosen among them.
SAMPLE_ROWS = 20_000
BORDERS = 31
# Up to this many rows are counted key by key; a window over the counts then finds the rank.
COUNTED_ROWS = 200_000


@dataclass(frozen=True)
class Cut:
    """The key at a rank: one row ``k``; how many rows have it, and how many of them come before the rank."""

    key: DataFrame
    ties: int
    before: int


def _comparable(field: T.StructField) -> list[Column]:
    """Columns in whose order any two different values differ; maps by their sorted entries."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.MapType):
        return [F.array_sort(F.map_entries(c))]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [c, c.cast("string")]  # the two zeros are equal numbers
    return [c]


def row_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """A struct that compares as the columns do one after the other, nulls first."""
    parts = [c for name in columns for c in _comparable(df.schema[name])]
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(parts)])


def _borders(keys: DataFrame, rows: int, rank: int) -> DataFrame:
    """``(at, k)``: different sampled keys in order, dense around the place of the rank."""
    share = min(1.0, SAMPLE_ROWS / rows)
    sample = keys.where(F.rand(17) < share).withColumn("at", F.row_number().over(Window.orderBy("k")))
    sample = stage(sample, "sample")
    size = sample.count()
    middle, spread = size * rank / rows, 4 * math.sqrt(size) + 2
    steps = range(-(BORDERS // 2 - 2), BORDERS // 2 - 1)
    wanted = {round(middle + spread * j / len(steps) * 2) for j in steps}
    wanted |= {size // 8, size // 4, size // 2, 3 * size // 4}
    chosen = sample.where(F.col("at").isin([max(1, min(size, w)) for w in wanted]))
    return chosen.groupBy("k").agg(F.min("at").alias("at"))


def _range(k: Column, borders: Column, first: int, last: int) -> Column:
    """The range of a key: ``2i`` between borders i - 1 and i, ``2i + 1`` at border i; by halving."""
    if first == last:
        return F.lit(2 * first)
    middle = (first + last) // 2
    border = F.get(borders, middle)
    return (
        F.when(k < border, _range(k, borders, first, middle))
        .when(k == border, F.lit(2 * middle + 1))
        .otherwise(_range(k, borders, middle + 1, last))
    )


def find_cut(keys: DataFrame, rank: int, total: int) -> Cut:
    """The key of the row at 0-based ``rank`` of the column ``k`` in ascending order.

    ``total`` is the number of rows. A round reads the keys of the range that
    is left: once for the sample, once for the counts. Only one number per
    range and two keys leave the executors.
    """
    left, rows, rank = keys, total, rank
    while rows > COUNTED_ROWS:
        borders = stage(_borders(left, rows, rank), "borders")
        n = borders.count()
        if not n:
            continue  # an empty sample: draw again
        row = borders.agg(F.array_sort(F.collect_list("k")).alias("a"))
        found = left.select(_range(F.col("k"), row.scalar(), 0, n).alias("r"))
        counts = {r["r"]: r["n"] for r in found.groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect()}
        at = before = 0
        while before + counts.get(at, 0) <= rank:
            before += counts.get(at, 0)
            at += 1
        rank, rows = rank - before, counts[at]
        ordered = row.select("a")
        if at % 2:
            return Cut(stage(ordered.select(F.get("a", at // 2).alias("k")), "cut"), rows, rank)
        if at:
            left = left.where(F.col("k") > ordered.select(F.get("a", at // 2 - 1)).scalar())
        if at // 2 < n:
            left = left.where(F.col("k") < ordered.select(F.get("a", at // 2)).scalar())
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(upto))
    cut = stage(counted.where((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)), "cut")
    n, end = cut.select("n", "upto").first()
    return Cut(cut.select("k"), n, rank - (end - n))


def label_first(
    df: DataFrame, n: int, order: Sequence[Column | str], column: str = "split", total: int | None = None
) -> DataFrame:
    """``column`` is ``train`` for the first ``n`` rows in ascending order (nulls first), ``test`` for the others.

    Rows that are equal in ``order`` are put in order of all other columns.
    Rows equal in everything cannot be told apart: as many of them as belong to
    the first ``n`` are ``train``. Rows are labelled by comparison with one key
    and do not move; only if the cut falls into a group of ties are the other
    columns of that group looked at. ``total`` is the number of rows, if known.
    """
    total = df.count() if total is None else total
    if n <= 0 or n >= total:
        return df.withColumn(column, F.lit("train" if n > 0 or not total else "test"))
    key = F.struct(*[(row_key(df, [c]) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    cut = find_cut(df.select(key.alias("k")), n, total)
    first = key < cut.key.scalar()
    if not cut.before:
        return df.withColumn(column, F.when(first, "train").otherwise("test"))
    tied, rest = key == cut.key.scalar(), row_key(df, df.columns)
    inner = find_cut(df.where(tied).select(rest.alias("k")), cut.before, cut.ties)
    before = first | (tied & (rest < inner.key.scalar()))
    labelled = df.withColumn(column, F.when(before, "train").otherwise("test"))
    if not inner.before:
        return labelled
    # equal rows on both sides: one of them is put out as often as it occurs
    equal = tied & (rest == inner.key.scalar())
    one = stage(df.where(equal).limit(1), "equal")
    times = [(inner.before, "train"), (inner.ties - inner.before, "test")]
    copies = None
    for count, label in times:
        part = df.sparkSession.range(count).select(F.lit(0).alias("__one"))
        part = part.join(F.broadcast(one.withColumn("__one", F.lit(0))), "__one").drop("__one").withColumn(column, F.lit(label))
        copies = part if copies is None else copies.unionByName(part)
    return labelled.where(~equal).unionByName(copies)
