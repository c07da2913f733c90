"""Declared schemas of the tables the operators exchange, and column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str

LABELLED_SERIES = "split STRING, label DOUBLE, series ARRAY<DOUBLE>"
MULTICHANNEL_SERIES = "split STRING, series ARRAY<ARRAY<DOUBLE>>, label STRING"
IDX_IMAGES = "pos LONG, image ARRAY<ARRAY<SMALLINT>>"
IDX_LABELS = "pos LONG, label LONG"
BATCH_EVENT = (
    "run STRING, phase STRING, epoch INT, loader_ix INT, batch_ix LONG, loss DOUBLE, n LONG"
)
METRIC_EVENT = (
    "run STRING, phase STRING, epoch INT, metric STRING, value DOUBLE, ts TIMESTAMP"
)
WEIGHTS = "layer INT, weight ARRAY<ARRAY<DOUBLE>>, bias ARRAY<DOUBLE>"


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def names(cols: str | Iterable[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def require_columns(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def require_numeric(df: DataFrame, *cols: str) -> None:
    require_columns(df, *cols)
    for c in cols:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise ValueError(f"column {c} must be numeric, is {df.schema[c].dataType.simpleString()}")


def require_integral(df: DataFrame, *cols: str) -> None:
    require_columns(df, *cols)
    for c in cols:
        if not isinstance(df.schema[c].dataType, T.IntegralType):
            raise ValueError(f"column {c} must be an integer, is {df.schema[c].dataType.simpleString()}")


def require_array(df: DataFrame, *cols: str) -> None:
    require_columns(df, *cols)
    for c in cols:
        if not isinstance(df.schema[c].dataType, T.ArrayType):
            raise ValueError(f"column {c} must be an array, is {df.schema[c].dataType.simpleString()}")
