"""Run-log series: running best, cumulative metrics, progress, latest values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.operators.joins import join_back
from stridemill.operators.order import running
from stridemill.schema import names, require_columns


def running_best(
    df: DataFrame,
    metric: str,
    order_by: str | Sequence[str] = "epoch",
    partition_by: str | Sequence[str] = "run",
    trigger: str = "increase",
    strict: bool = False,
    max_group_rows: int | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add ``best`` (before the epoch) and ``improved``.

    "increase" improves on a strictly larger value. "decrease" improves unless
    the value is larger, so a tie counts; with ``strict`` it must be smaller.
    The first epoch is compared with -inf or +inf. NaN is an error: no later
    value could be compared with it.
    """
    if trigger not in ("increase", "decrease"):
        raise ValueError("trigger must be 'increase' or 'decrease'")
    require_columns(df, metric)
    up = trigger == "increase"
    m = F.when(
        F.isnan(F.col(metric).cast("double")), F.raise_error(F.lit("metric is NaN")).cast("double")
    ).otherwise(F.col(metric).cast("double"))
    out = running(
        df.withColumn("__m", m),
        {"best": ("max" if up else "min", "__m")},
        order_by,
        partition_by,
        inclusive=False,
        max_group_rows=max_group_rows,
        chunk_rows=chunk_rows,
    )
    best = F.coalesce("best", F.lit(float("-inf" if up else "inf")))
    if up:
        improved = F.col("__m") > best
    elif strict:
        improved = F.col("__m") < best
    else:
        improved = F.col("__m") <= best
    return out.withColumn("best", best).withColumn("improved", improved).drop("__m")


def cumulative_metric(
    df: DataFrame,
    numerator: str,
    count: str,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] = (),
    column: str = "cumulative",
    max_group_rows: int | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Running ``sum(numerator) / sum(count)`` over all batches so far."""
    out = running(
        df,
        {"__num": ("sum", numerator), "__cnt": ("sum", count)},
        order_by,
        partition_by,
        max_group_rows=max_group_rows,
        chunk_rows=chunk_rows,
    )
    return out.withColumn(column, F.try_divide("__num", "__cnt")).drop("__num", "__cnt")


def progress(
    df: DataFrame,
    n: str,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str],
    max_group_rows: int | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add ``seen``, ``total`` and ``percent`` per group."""
    out = running(
        df,
        {"seen": ("sum", n)},
        order_by,
        partition_by,
        max_group_rows=max_group_rows,
        chunk_rows=chunk_rows,
        totals={"total": n},
    )
    return out.withColumn("percent", 100.0 * F.try_divide(F.col("seen"), F.col("total")))


def latest_values(df: DataFrame, value: str, step: str, by: str | Sequence[str]) -> DataFrame:
    """The value at the highest step of each key."""
    return df.groupBy(*names(by)).agg(
        F.max_by(value, step).alias(value), F.max(step).alias(step)
    )


def column_max_normalise(df: DataFrame, value: str, by: str | Sequence[str]) -> DataFrame:
    """Divide by the largest value of the same key; a zero maximum gives NULL.

    The maxima are a partial aggregate joined back; AQE splits the rows of a
    frequent key over several tasks.
    """
    keys = names(by)
    tops = df.groupBy(*keys).agg(F.max(value).alias("__top"))
    return join_back(df, tops, keys).withColumn(
        value, F.try_divide(F.col(value), F.col("__top"))
    ).drop("__top")


def latest_checkpoint(df: DataFrame, name: str = "name") -> DataFrame:
    """The highest epoch among checkpoint names; names that are no 64-bit number are ignored."""
    digits = F.when(F.col(name).rlike(r"^[0-9]+$"), F.col(name)).try_cast("long")
    return df.agg(F.max(digits).alias("epoch"))


def best_epoch(
    df: DataFrame, metric: str, by: str | Sequence[str] = "run", trigger: str = "increase"
) -> DataFrame:
    """The epoch with the best metric, the first one on a tie; NaN is never best."""
    if trigger not in ("increase", "decrease"):
        raise ValueError("trigger must be 'increase' or 'decrease'")
    up = trigger == "increase"
    m = F.col(metric).cast("double")
    rank: Column = F.struct((m if up else -m).alias("m"), (-F.col("epoch")).alias("e"))
    return df.where(m.isNotNull() & ~F.isnan(m)).groupBy(*names(by)).agg(
        F.max_by("epoch", rank).alias("epoch"), F.max_by(metric, rank).alias(metric)
    )
