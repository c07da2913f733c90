"""Order over distributed rows: positions, running values, row frames.

Spark rows have no order, so every function here takes ``order_by``, which must
be a total order inside each ``partition_by`` group.

One group may hold a large part of all rows, so a plain
``Window.partitionBy(key)`` is used only for groups that were counted and found
small enough for one task. The others, and series with no key at all, are
sorted by range partitions, staged with their row number and processed in
fixed-size chunks of consecutive rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window, WindowSpec
from pyspark.sql import functions as F

from stridemill.operators.joins import join_back, same_keys
from stridemill.schema import names, require_columns
from stridemill.session import stage

# A group up to this many rows is left to one window task (it sorts with spill).
GROUP_ROWS = 1_000_000
# Groups above total / HOT_KEYS are hot, so there are never more hot keys than this.
HOT_KEYS = 100_000
# Consecutive rows per chunk where a series is split.
CHUNK_ROWS = 250_000
# A table with one row per chunk never has more rows than this.
MAX_CHUNKS = 1_000_000
# Bytes of a range partition, as the plan estimates them.
RANGE_BYTES = 128 << 20
# Up to this length a frame is read with LEAD columns, above from chunk arrays.
LEAD_LENGTH = 8
# Rows per chunk array, and bytes of them, beside those that a frame reaches.
ARRAY_ROWS = 4096
ARRAY_BYTES = 16 << 20

Hot = DataFrame | bool | None

_ID = "__ord_row_id"
_RUN_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


@dataclass(frozen=True)
class Ranked:
    """Rows with a 0-based global position, and how many there are."""

    df: DataFrame
    total: int


def range_partitions(df: DataFrame) -> int | None:
    """Partitions for a sort of ``df`` by the plan's estimate of its size.

    None, which leaves the number to the session and AQE, if that is enough or
    the size is unknown.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = -(-size // RANGE_BYTES)
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return None if wanted <= default or size >= 1 << 60 else int(wanted)


def rank_globally(df: DataFrame, order_by: str | Sequence[str], pos: str = "pos") -> Ranked:
    """0-based position over all rows, without a single-partition window.

    Range-partition and sort, write the rows with their id once, then add the
    number of rows in earlier partitions. Row ids are only stable once written:
    the range bounds come from a sample and may differ when recomputed.
    """
    order = names(order_by)
    require_columns(df, *order)
    parts = range_partitions(df)
    staged = stage(
        (df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order))
        .sortWithinPartitions(*order)
        .withColumn(_ID, F.monotonically_increasing_id()),
        "ranked",
    )
    run = F.shiftright(_ID, _RUN_BITS)
    local = F.col(_ID).bitwiseAND(F.lit((1 << _RUN_BITS) - 1))
    # one row per range partition
    counts = staged.groupBy(run.alias("run")).count().orderBy("run").collect()
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["run"], total))
        total += row["count"]
    base = df.sparkSession.createDataFrame(offsets, "__ord_run LONG, __ord_base LONG")
    ranked = (
        staged.withColumn("__ord_run", run)
        .join(F.broadcast(base), "__ord_run")
        .withColumn(pos, F.col("__ord_base") + local)
        .drop("__ord_run", "__ord_base", _ID)
    )
    return Ranked(ranked, total)


def hot_keys(
    df: DataFrame, keys: str | Sequence[str], max_group_rows: int | None = None
) -> DataFrame | None:
    """The keys with too many rows for one task, or None if there are none.

    Counting needs the key columns only, combines before the shuffle and is one
    job, which also writes the keys that may be hot. A key
    is hot above ``max(max_group_rows, total / HOT_KEYS)`` rows, so there are
    at most ``HOT_KEYS`` of them and the table can be broadcast.
    """
    keys = names(keys)
    least, seen = max_group_rows or GROUP_ROWS, Observation()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__ord_n"))
    counts = counts.observe(seen, F.sum("__ord_n").alias("total"), F.max("__ord_n").alias("biggest"))
    large = stage(counts.where(F.col("__ord_n") > least), "hot-keys")
    limit = max(least, math.ceil((seen.get["total"] or 0) / HOT_KEYS))
    if (seen.get["biggest"] or 0) <= limit:
        return None
    return large.where(F.col("__ord_n") > limit).select(*keys)


def split_hot(
    df: DataFrame, keys: str | Sequence[str], max_group_rows: int | None = None, hot: Hot = None
) -> tuple[DataFrame, DataFrame | None]:
    """``(cold, hot)``: rows of keys that fit one task, and the rest or None.

    The rows are read twice at most: once for counting the keys, and once more,
    if there are hot ones, to mark and write them. ``hot`` is a table of hot
    keys (or of a part of the key columns) that is known already, or False if
    there are none; then nothing is counted.
    """
    table = hot_keys(df, keys, max_group_rows) if hot is None else hot
    if table is None or table is False:
        return df, None
    keys = table.columns
    renamed = table.withColumnsRenamed({k: f"__ord_hot_{k}" for k in keys}).withColumn("__ord_is_hot", F.lit(True))
    marked = stage(
        df.join(F.broadcast(renamed), same_keys(keys, "__ord_hot_"), "left")
        .drop(*[f"__ord_hot_{k}" for k in keys])
        .withColumn("__ord_is_hot", F.col("__ord_is_hot").isNotNull()),
        "marked",
    )
    return (
        marked.where(~F.col("__ord_is_hot")).drop("__ord_is_hot"),
        marked.where("__ord_is_hot").drop("__ord_is_hot"),
    )


def with_position(
    df: DataFrame,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] = (),
    pos: str = "pos",
    total: str | None = None,
    max_group_rows: int | None = None,
    hot: Hot = None,
) -> DataFrame:
    """Add the 0-based position, and on request the row count of the group."""
    keys, order = names(partition_by), names(order_by)
    require_columns(df, *keys, *order)
    if not keys:
        ranked = rank_globally(df, order, pos)
        return ranked.df.withColumn(total, F.lit(ranked.total)) if total else ranked.df
    cold, hot = split_hot(df, keys, max_group_rows, hot)
    spec = Window.partitionBy(*keys)
    out = cold.withColumn(pos, F.row_number().over(spec.orderBy(*order)).cast("long") - 1)
    if total:
        out = out.withColumn(total, F.count(F.lit(1)).over(spec))
    if hot is None:
        return out
    ranked = rank_globally(hot, [*keys, *order], "__ord_gpos").df
    # at most HOT_KEYS rows
    starts = ranked.groupBy(*keys).agg(
        F.min("__ord_gpos").alias("__ord_start"), F.count(F.lit(1)).alias("__ord_n")
    )
    located = join_back(ranked, starts, keys, small=True).withColumn(pos, F.col("__ord_gpos") - F.col("__ord_start"))
    if total:
        located = located.withColumn(total, F.col("__ord_n"))
    return out.unionByName(located.drop("__ord_gpos", "__ord_start", "__ord_n"))


def frames(
    df: DataFrame,
    value: Column,
    length: int,
    reach: int,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] = (),
    tail: Sequence[Column] = (),
    stride: int = 1,
    max_group_rows: int | None = None,
    chunk_rows: int | None = None,
    hot: Hot = None,
    row_bytes: int = 16,
) -> DataFrame:
    """One row per start that has a row ``reach`` places after it.

    Returns the keys, ``pos`` (of the start, a multiple of ``stride``), ``x``
    (``value`` of the ``length`` rows from the start on, NULLs kept) and the
    ``tail`` columns taken from the row ``reach`` places later. ``row_bytes``
    tells how wide ``value`` is: chunks of wide rows have fewer of them.
    """
    if length < 1 or reach < length - 1 or stride < 1:
        raise ValueError(
            f"need length >= 1, reach >= length - 1 and stride >= 1, got {length}, {reach}, {stride}"
        )
    keys, order = names(partition_by), names(order_by)
    require_columns(df, *keys, *order)
    narrow = df.select(
        *dict.fromkeys([*keys, *order]),
        value.alias("__ord_v"),
        F.struct(F.lit(True).alias("__ord_here"), *tail).alias("__ord_tail"),
    )
    if stride == 1 and length <= LEAD_LENGTH:
        return _lead_frames(narrow, length, reach, order, keys, max_group_rows, chunk_rows, hot)
    return _array_frames(narrow, length, reach, stride, order, keys, max_group_rows, array_rows(reach, row_bytes, chunk_rows), hot)


def array_rows(reach: int, row_bytes: int, chunk_rows: int | None = None) -> int:
    """Rows of a chunk array: ``ARRAY_BYTES`` at most, but no fewer than a frame reaches."""
    usual = chunk_rows or min(max(ARRAY_ROWS, 4 * reach), ARRAY_BYTES // max(1, row_bytes))
    return max(usual, reach, 1)


def _with_halo(placed: DataFrame, pos: str, size: int, reach: int) -> DataFrame:
    """Number the chunks of ``size`` rows and copy the first ``reach`` rows of
    each into the chunk before it, so that no frame leaves its chunk."""
    home = F.floor(F.col(pos) / size)
    copied = (F.pmod(pos, F.lit(size)) < reach) & (home > 0)
    targets = F.when(copied, F.array(home, home - 1)).otherwise(F.array(home))
    return placed.withColumn("__ord_chunk", F.explode(targets))


def _lead_frames(
    narrow: DataFrame,
    length: int,
    reach: int,
    order: list[str],
    keys: list[str],
    max_group_rows: int | None,
    chunk_rows: int | None,
    hot: Hot,
) -> DataFrame:
    """Short frames as LEAD columns of one window."""

    def cut(rows: DataFrame, spec: WindowSpec) -> DataFrame:
        values = [F.lead("__ord_v", i).over(spec) if i else F.col("__ord_v") for i in range(length)]
        return rows.withColumn("__ord_x", F.array(*values)).withColumn(
            "__ord_end", F.lead("__ord_tail", reach).over(spec)
        )

    def shape(rows: DataFrame, pos: Column) -> DataFrame:
        return rows.where(F.col("__ord_end").isNotNull()).select(
            *keys, pos.alias("pos"), F.col("__ord_x").alias("x"), "__ord_end.*"
        ).drop("__ord_here")

    out, series = None, narrow
    if keys:
        cold, series = split_hot(narrow, keys, max_group_rows, hot)
        spec = Window.partitionBy(*keys).orderBy(*order)
        rows = cut(cold, spec).withColumn("__ord_pos", F.row_number().over(spec).cast("long") - 1)
        out = shape(rows, F.col("__ord_pos"))
        if series is None:
            return out

    size = max(chunk_rows or CHUNK_ROWS, reach, 1)
    ranked = rank_globally(series, [*keys, *order], "__ord_gpos").df
    if keys:
        starts = ranked.groupBy(*keys).agg(F.min("__ord_gpos").alias("__ord_start"))
        ranked = join_back(ranked, starts, keys, small=True)
    else:
        ranked = ranked.withColumn("__ord_start", F.lit(0).cast("long"))
    chunked = _with_halo(ranked, "__ord_gpos", size, reach)
    spec = Window.partitionBy(*keys, "__ord_chunk").orderBy("__ord_gpos")
    rows = cut(chunked, spec).where(F.col("__ord_chunk") == F.floor(F.col("__ord_gpos") / size))
    split = shape(rows, F.col("__ord_gpos") - F.col("__ord_start"))
    return split if out is None else out.unionByName(split)


def _array_frames(
    narrow: DataFrame,
    length: int,
    reach: int,
    stride: int,
    order: list[str],
    keys: list[str],
    max_group_rows: int | None,
    size: int,
    hot: Hot,
) -> DataFrame:
    """Longer or strided frames as slices of one sorted array per chunk.

    The cost per frame does not grow with its length as a window aggregate
    would, and frames that the stride skips are never built.
    """
    placed = with_position(narrow, order, keys, "__ord_pos", max_group_rows=max_group_rows, hot=hot)
    # at most size + reach rows per group
    chunks = (
        _with_halo(placed, "__ord_pos", size, reach)
        .groupBy(*keys, "__ord_chunk")
        .agg(
            F.sort_array(F.collect_list(F.struct("__ord_pos", "__ord_v", "__ord_tail"))).alias("__ord_rows")
        )
        .select(
            *keys,
            (F.col("__ord_chunk") * size).alias("__ord_base"),
            F.col("__ord_rows.__ord_v").alias("__ord_x"),
            F.col("__ord_rows.__ord_tail").alias("__ord_tails"),
        )
    )
    first = F.pmod(-F.col("__ord_base"), F.lit(stride)).cast("int")
    last = F.least(F.size("__ord_x") - reach, F.lit(size)) - 1
    at = F.col("__ord_at")
    return (
        chunks.where(first <= last)
        .withColumn("__ord_at", F.explode(F.sequence(first, last, F.lit(stride))))
        .select(
            *keys,
            (F.col("__ord_base") + at).alias("pos"),
            F.slice("__ord_x", at + 1, F.lit(length)).alias("x"),
            F.get("__ord_tails", at + reach).alias("__ord_end"),
        )
        .select(*keys, "pos", "x", "__ord_end.*")
        .drop("__ord_here")
    )


_RUNNING = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(
    df: DataFrame,
    values: dict[str, tuple[str, str]],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] = (),
    inclusive: bool = True,
    max_group_rows: int | None = None,
    chunk_rows: int | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add running aggregates, ``{output: (sum|count|max|min, column)}``.

    ``totals`` adds whole-group sums, ``{output: column}``, from the same pass.
    With ``inclusive=False`` the current row is left out. Hot and unkeyed
    series are folded per chunk first; the chunk totals are then accumulated
    (one row per chunk) and added to the running value inside the chunk.
    """
    keys, order = names(partition_by), names(order_by)
    totals = totals or {}
    require_columns(df, *keys, *order, *[c for _, c in values.values()], *totals.values())
    end = Window.currentRow if inclusive else -1

    def add(rows: DataFrame, spec: WindowSpec, prefix: str = "") -> DataFrame:
        frame = spec.rowsBetween(Window.unboundedPreceding, end)
        return rows.withColumns(
            {prefix + out: _RUNNING[fn][0](F.col(c)).over(frame) for out, (fn, c) in values.items()}
        )

    done = None
    series = df
    if keys:
        cold, series = split_hot(df, keys, max_group_rows)
        done = add(cold, Window.partitionBy(*keys).orderBy(*order))
        whole = Window.partitionBy(*keys)
        done = done.withColumns({out: F.sum(c).over(whole) for out, c in totals.items()})
        if series is None:
            return done

    placed = rank_globally(series, [*keys, *order], "__ord_gpos")
    size = max(chunk_rows or CHUNK_ROWS, math.ceil(placed.total / MAX_CHUNKS))
    ranked = placed.df.withColumn("__ord_chunk", F.floor(F.col("__ord_gpos") / size))
    group = [*keys, "__ord_chunk"]
    before = Window.partitionBy(*keys).orderBy("__ord_chunk").rowsBetween(Window.unboundedPreceding, -1)
    merged = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    chunks = (
        ranked.groupBy(*group)
        .agg(
            *[_RUNNING[fn][0](F.col(c)).alias(f"__ord_c_{out}") for out, (fn, c) in values.items()],
            *[F.sum(c).alias(f"__ord_t_{out}") for out, c in totals.items()],
        )
        .select(
            *group,
            *[merged[fn](f"__ord_c_{out}").over(before).alias(f"__ord_b_{out}") for out, (fn, _) in values.items()],
            *[F.sum(f"__ord_t_{out}").over(Window.partitionBy(*keys)).alias(out) for out in totals],
        )
    )
    inside = add(ranked, Window.partitionBy(*group).orderBy("__ord_gpos"), "__ord_i_")
    split = join_back(inside, chunks, group).withColumns(
        {
            out: _RUNNING[fn][1](F.col(f"__ord_b_{out}"), F.col(f"__ord_i_{out}"))
            for out, (fn, _) in values.items()
        }
    )
    split = split.select(*df.columns, *values, *totals)
    return split if done is None else done.unionByName(split)


def positional_join(
    left: DataFrame,
    right: DataFrame,
    left_order: str | Sequence[str],
    right_order: str | Sequence[str],
    pos: str = "pos",
) -> DataFrame:
    """Join the i-th row of one table with the i-th of the other.

    Trimmed to the shorter table. Column names must not overlap.
    """
    overlap = set(left.columns) & set(right.columns)
    if overlap:
        raise ValueError(f"both sides have columns {sorted(overlap)}")
    return with_position(left, left_order, pos=pos).join(
        with_position(right, right_order, pos=pos), pos
    )
