"""User functions on samples and targets, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.schema import require_columns

Series = Callable[[pd.Series], pd.Series]


def _apply(fn: Series | Callable[[Column], Column], column: str, type_name: str | None) -> Column:
    """A function of a Column is used as it is, one of a pandas Series with its type."""
    if type_name is None:
        return fn(F.col(column))

    def run(values: pd.Series) -> pd.Series:
        return fn(values)

    return F.pandas_udf(run, type_name)(F.col(column))


def apply_transforms(
    df: DataFrame,
    transform: Series | Callable[[Column], Column] | None = None,
    target_transform: Series | Callable[[Column], Column] | None = None,
    data: str = "data",
    target: str = "target",
    transform_type: str | None = None,
    target_type: str | None = None,
) -> DataFrame:
    """Replace ``data`` and ``target`` by the user's functions of them.

    Without a type the function takes and returns a Column and stays in the
    JVM; with a type it takes and returns a pandas Series.
    """
    out = df
    if transform is not None:
        require_columns(df, data)
        out = out.withColumn(data, _apply(transform, data, transform_type))
    if target_transform is not None:
        require_columns(df, target)
        out = out.withColumn(target, _apply(target_transform, target, target_type))
    return out
