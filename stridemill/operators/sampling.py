"""Pseudo-random order, exact random splits and samples, concatenation.

Random order is the order of a row hash. Hashes are spread evenly whatever the
data looks like, so a prefix of the digest cuts the rows into even cells, and
cell sizes turn a rank inside a cell into a global position. The id columns
should be unique per row; rows of equal ids are in order of their columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemill.functions.scalars import row_hash
from stridemill.operators.order import rank_globally, with_position
from stridemill.operators.selection import label_first, row_key
from stridemill.schema import names, require_columns
from stridemill.session import stage

# Rows of a cell, on average at most, and hex digits of the first level of cells.
CELL_ROWS = 50_000
FIRST_DIGITS = 4
# Cells of a span, in which draws meet cells.
SPAN_CELLS = 16


def cell_digits(total: int) -> int:
    """Hex digits of the digest that name a cell: as many as keep cells small, whatever the number of rows."""
    digits = 1
    while total > CELL_ROWS * 16**digits:
        digits += 1
    return digits


def _cell(digest: Column, digits: int) -> Column:
    return F.substr(digest, F.lit(1), F.lit(digits))


def _cells(df: DataFrame, digest: Column, digits: int) -> DataFrame:
    """``(__cell, __n, __base)``: size and first position of each cell, in two levels.

    Cells that share their first digits are added up among themselves; the sums
    of those (at most 65,536) are added up in one task.
    """
    sizes = df.groupBy(_cell(digest, digits).alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__first", _cell(F.col("__cell"), min(digits, FIRST_DIGITS)))
    earlier = Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.groupBy("__first").agg(F.sum("__n").alias("__size"))
    firsts = firsts.select("__first", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__first").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("__start") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    return sizes.join(F.broadcast(firsts), "__first").select("__cell", "__n", base.alias("__base"))


def _ranked(df: DataFrame, digest: Column, digits: int) -> DataFrame:
    """Cell and 1-based rank in the cell; rows of equal ids in order of all their columns."""
    spec = Window.partitionBy("__cell").orderBy("__h", row_key(df, df.columns))
    return df.withColumn("__h", digest).withColumn("__cell", _cell(F.col("__h"), digits)).withColumn(
        "__rank", F.row_number().over(spec)
    )


def hash_position(
    df: DataFrame,
    ids: str | Sequence[str],
    *salt: object,
    pos: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """0-based position in hash order: one shuffle, by cell; cells stay small however many rows there are."""
    ids = names(ids)
    require_columns(df, *ids)
    digest, rows = row_hash(ids, *salt), df.count()
    digits = cell_digits(rows)
    ranked = (
        _ranked(df, digest, digits)
        .join(_cells(df, digest, digits).drop("__n"), "__cell")
        .withColumn(pos, F.col("__base") + F.col("__rank") - 1)
    )
    if total:
        ranked = ranked.withColumn(total, F.lit(rows).cast("long"))
    return ranked.drop("__h", "__cell", "__rank", "__base")


def random_split(
    df: DataFrame,
    ratio: float,
    ids: str | Sequence[str],
    seed: int = 0,
    column: str = "split",
) -> DataFrame:
    """Random train/test split with exactly ``int(ratio * n)`` training rows.

    The rows with the smallest hashes of their ids are training rows. Only the
    hash at the cut is looked for, by counting; the rows are not moved. Rows of
    equal ids are taken in order of their other columns, so the size is exact
    on any table.
    """
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be between 0 and 1")
    ids = names(ids)
    require_columns(df, *ids)
    total = df.count()
    return label_first(df, int(ratio * total), [row_hash(ids, seed)], column, total)


def sample_with_replacement(
    df: DataFrame, n: int, ids: str | Sequence[str], seed: int = 0, draw: str = "draw"
) -> DataFrame:
    """Exactly ``n`` uniform draws; a row drawn twice appears twice.

    Draw ``i`` takes the row at hash position ``hash(i, seed) mod N``. Only rows
    in cells that were drawn from are ranked.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    ids = names(ids)
    require_columns(df, *ids)
    spark = df.sparkSession
    digest, total = row_hash(ids, seed), df.count()
    if total == 0:
        if n:
            raise ValueError("cannot draw from an empty table")
        return df.withColumn(draw, F.lit(0).cast("long")).limit(0)
    digits = cell_digits(total)
    cells = stage(_cells(df, digest, digits), "cells")
    # find the cell of a position: both sides meet in spans of equal width
    width = max(1, total * SPAN_CELLS // 16**digits)
    first = F.floor(F.col("__base") / width)
    last = F.floor((F.col("__base") + F.col("__n") - 1) / width)
    spans = cells.withColumn("__span", F.explode(F.sequence(first, last)))
    bits = F.conv(F.substr(row_hash(["draw"], seed), F.lit(1), F.lit(15)), 16, 10).cast("long")
    draws = (
        spark.range(n)
        .withColumnRenamed("id", "draw")
        .withColumn("__pos", F.pmod(bits, F.lit(total)))
        .withColumn("__span", F.floor(F.col("__pos") / width))
    )
    located = (
        draws.join(spans, "__span")
        .where((F.col("__base") <= F.col("__pos")) & (F.col("__pos") < F.col("__base") + F.col("__n")))
        .select(F.col("draw").alias(draw), "__cell", (F.col("__pos") - F.col("__base") + 1).alias("__rank"))
    )
    drawn = located.select("__cell").distinct()
    chosen = df.withColumn("__c", _cell(digest, digits)).join(drawn.withColumnRenamed("__cell", "__c"), "__c", "left_semi")
    ranked = _ranked(chosen.drop("__c"), digest, digits)
    return ranked.join(located, ["__cell", "__rank"]).drop("__h", "__cell", "__rank")


def first_n(df: DataFrame, n: int, order_by: str | Sequence[str]) -> DataFrame:
    """The first n rows of a total order (all rows if there are fewer)."""
    return df.orderBy(*names(order_by)).limit(n)


def take_positions(
    df: DataFrame, index: DataFrame, order_by: str | Sequence[str]
) -> DataFrame:
    """Rows at the positions listed in ``index(ord, pos)``; repeats are kept.

    ``ord`` tells the order of the list. A position outside the table gives no
    row.
    """
    require_columns(index, "ord", "pos")
    return with_position(df, order_by).join(index.select("ord", "pos"), "pos")


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """All tables, unordered; ``loader_ix`` numbers the source."""
    if not sources:
        raise ValueError("nothing to concatenate")
    numbered = [df.withColumn("loader_ix", F.lit(i)) for i, df in enumerate(sources)]
    out = numbered[0]
    for df in numbered[1:]:
        out = out.unionByName(df)
    return out


def concat_sources(
    sources: Sequence[DataFrame], order_by: str | Sequence[str], pos: str = "pos"
) -> DataFrame:
    """One table after the other: each is sorted alone and put behind those before it."""
    if not sources:
        raise ValueError("nothing to concatenate")
    placed, before = [], 0
    for df in sources:
        ranked = rank_globally(df, order_by, pos)
        placed.append(ranked.df.withColumn(pos, F.col(pos) + F.lit(before)))
        before += ranked.total
    return union_sources(placed)
