"""Run-log tables: wide metric pivots, histories, run parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridemill.functions.scalars import merge_maps
from stridemill.schema import names, require_array, require_columns


def metrics_wide(
    events: DataFrame,
    metrics: Sequence[str],
    by: Sequence[str] = ("phase", "epoch"),
    newest: str | None = None,
) -> DataFrame:
    """One row per phase and epoch, one column per listed metric.

    The list is fixed by the caller, so the columns do not drift between
    appends and no extra job looks for distinct names; an event of another
    metric is an error. Of several values the one with the highest ``newest``
    counts (``ts`` if there is such a column); without such a column a second
    value is an error.
    """
    require_columns(events, *by, "metric", "value")
    newest = newest or ("ts" if "ts" in events.columns else None)
    listed = F.col("metric").isin(*metrics) if metrics else F.lit(False)
    unknown = F.raise_error(F.concat(F.lit("metric that is not listed: "), F.coalesce("metric", F.lit("NULL"))))
    known = events.withColumn("metric", F.when(listed, F.col("metric")).otherwise(unknown.cast("string")))
    if newest:
        value = F.max_by("value", F.when(F.col("value").isNotNull(), F.struct(newest, "value")))
    else:
        second = F.raise_error(F.lit("two values of one metric and no column that orders them")).cast("double")
        value = F.when(F.count("value") > 1, second).otherwise(F.max("value"))
    return known.groupBy(*by).pivot("metric", list(metrics)).agg(value)


def history_rows(
    df: DataFrame, keys: Sequence[str], widths: Mapping[str, int | None]
) -> DataFrame:
    """Array columns of one history row -> one row per element.

    ``widths`` gives the inner width of a 2-D member, which becomes columns
    ``name_0 .. name_{w-1}``, or None for a 1-D member. Members of unequal
    length are an error, as is one that is not an array.
    """
    require_columns(df, *keys)
    require_array(df, *widths)
    members = list(widths)
    first = F.size(members[0])
    same = F.lit(True)
    for m in members[1:]:
        same = same & (F.size(m) == first)
    zipped = F.when(same, F.arrays_zip(*members)).otherwise(
        F.raise_error(F.lit("history members differ in length"))
    )
    rows = df.select(*keys, F.posexplode(zipped).alias("ix", "__h"))
    out: list[Column] = []
    for m, width in widths.items():
        nested = isinstance(df.schema[m].dataType.elementType, T.ArrayType)
        if nested != (width is not None):
            raise ValueError(f"{m}: give a width for a 2-D member and None for a 1-D one")
        if width is None:
            out.append(F.col(f"__h.{m}").alias(m))
        else:
            out += [F.get(F.col(f"__h.{m}"), i).alias(f"{m}_{i}") for i in range(width)]
    return rows.select(*keys, "ix", *out)


def run_parameters(
    spark: SparkSession, params: Mapping[str, object], hyperparams: Mapping[str, object]
) -> DataFrame:
    """One row ``params MAP``; hyper-parameters override parameters of the same name."""
    text = "MAP<STRING, STRING>"
    row = ({k: str(v) for k, v in params.items()}, {k: str(v) for k, v in hyperparams.items()})
    df = spark.createDataFrame([row], f"base {text}, hyper {text}")
    return df.select(merge_maps("base", "hyper").alias("params"))


def metric_events(wide: DataFrame, metrics: Sequence[str], keys: str | Sequence[str]) -> DataFrame:
    """Wide metric columns -> ``(keys, metric, value)`` rows."""
    return wide.unpivot(names(keys), list(metrics), "metric", "value")
