"""Joins by key, dictionary and epoch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.schema import names, require_columns


def same_keys(keys: Sequence[str], prefix: str) -> Column:
    """``key <=> prefix+key`` for all keys: NULL keys match each other."""
    on = F.lit(True)
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
        on = on & same if i else same
    return on


def join_back(
    df: DataFrame,
    stats: DataFrame,
    keys: str | Sequence[str],
    small: bool = False,
    how: str = "inner",
) -> DataFrame:
    """Add the columns of ``stats`` (one row per key) to the rows of ``df``.

    ``small`` marks a table whose row count has a proven bound and broadcasts
    it. Otherwise the choice is left to AQE, which knows the real size and
    splits skewed partitions.
    """
    keys = names(keys)
    require_columns(df, *keys)
    renamed = stats.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    joined = df.join(F.broadcast(renamed) if small else renamed, same_keys(keys, "__k_"), how)
    return joined.drop(*[f"__k_{k}" for k in keys])


def lookup(df: DataFrame, table: DataFrame, key: str, handle_unseen: str = "null") -> DataFrame:
    """Dictionary lookup: left join with a table of unique keys."""
    require_columns(df, key)
    require_columns(table, key)
    if handle_unseen not in ("null", "drop"):
        raise ValueError("handle_unseen must be 'null' or 'drop'")
    return df.join(table, key, "left" if handle_unseen == "null" else "inner")


def join_metric_frames(frames: Sequence[DataFrame], on: str | Sequence[str] = "epoch") -> DataFrame:
    """Full outer join of metric tables; epochs missing in one give NULL."""
    if not frames:
        raise ValueError("nothing to join")
    out = frames[0]
    for df in frames[1:]:
        out = out.join(df, names(on), "full_outer")
    return out


def learning_curve(
    events: DataFrame,
    metric: str = "loss",
    phases: tuple[str, str] = ("training", "validation"),
    by: str | Sequence[str] = "run",
    how: str = "inner",
) -> DataFrame:
    """Training and validation value of a metric side by side, per epoch.

    Both sides come from one table, so one grouping takes the place of a join.
    ``how`` is inner (epochs with both values) or full_outer.
    """
    if how not in ("inner", "full_outer"):
        raise ValueError("how must be 'inner' or 'full_outer'")
    keys = [*names(by), "epoch"]
    require_columns(events, *keys, "phase", "metric", "value")
    wanted = events.where((F.col("metric") == metric) & F.col("phase").isin(*phases))
    there = [F.col("phase") == p for p in phases]
    sides = wanted.groupBy(*keys).agg(
        *[F.max(F.when(t, F.col("value"))).alias(p) for t, p in zip(there, phases)],
        (F.max(there[0].cast("int")) + F.max(there[1].cast("int"))).alias("__sides"),
    )
    return (sides.where(F.col("__sides") == 2) if how == "inner" else sides).drop("__sides")
