"""Scalers: ``fit`` reads one aggregate row, ``transform`` is a column expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.functions.arrays import clamp
from stridemill.schema import ColumnLike, col, names, require_array, require_numeric


@dataclass(frozen=True)
class MinMax:
    """One minimum and maximum for the whole column; constant input gives NULL."""

    low: float | None
    high: float | None

    @staticmethod
    def fit(df: DataFrame, column: str, fit_on: Column | None = None) -> MinMax:
        """``fit_on`` restricts the rows, for instance to the training part."""
        require_numeric(df, column)
        rows = df if fit_on is None else df.where(fit_on)
        low, high = rows.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
        return MinMax(low, high)

    @property
    def _low(self) -> Column:
        return F.lit(self.low).cast("double")

    @property
    def _span(self) -> Column:
        return F.lit(self.high).cast("double") - self._low

    def transform(self, x: ColumnLike) -> Column:
        return F.try_divide(col(x) - self._low, self._span)

    def inverse(self, x: ColumnLike) -> Column:
        return col(x) * self._span + self._low


@dataclass(frozen=True)
class Standard:
    """Mean and unbiased deviation per column; one row or a constant gives NULL."""

    mean: dict[str, float | None]
    std: dict[str, float | None]

    @staticmethod
    def fit(df: DataFrame, columns: str | Sequence[str], fit_on: Column | None = None) -> Standard:
        columns = names(columns)
        require_numeric(df, *columns)
        rows = df if fit_on is None else df.where(fit_on)
        row = rows.agg(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
        ).first()
        return Standard({c: row[f"m_{c}"] for c in columns}, {c: row[f"s_{c}"] for c in columns})

    def transform(self, column: str) -> Column:
        mean, std = F.lit(self.mean[column]).cast("double"), F.lit(self.std[column]).cast("double")
        return F.try_divide(F.col(column) - mean, std)

    def inverse(self, column: str) -> Column:
        mean, std = F.lit(self.mean[column]).cast("double"), F.lit(self.std[column]).cast("double")
        return F.col(column) * std + mean


@dataclass(frozen=True)
class StandardArray:
    """``Standard`` for the elements of an array column, fit in one aggregate."""

    mean: tuple[float, ...]
    std: tuple[float, ...]
    count: int

    @staticmethod
    def fit(df: DataFrame, column: str, fit_on: Column | None = None) -> StandardArray:
        require_array(df, column)
        rows = df if fit_on is None else df.where(fit_on)
        vector = array_to_vector(F.col(column).cast("array<double>"))
        row = (
            rows.select(vector.alias("v"))
            .select(Summarizer.metrics("count", "mean", "std").summary(F.col("v")).alias("s"))
            .select(
                F.col("s.count").alias("n"),
                vector_to_array("s.mean").alias("mean"),
                vector_to_array("s.std").alias("std"),
            )
            .first()
        )
        return StandardArray(tuple(row["mean"]), tuple(row["std"]), row["n"])

    def _pairs(self) -> Column:
        undefined = self.count < 2
        return F.array(
            *[
                F.struct(F.lit(m).alias("m"), F.lit(None if undefined else s).cast("double").alias("s"))
                for m, s in zip(self.mean, self.std)
            ]
        )

    def transform(self, x: ColumnLike) -> Column:
        return F.zip_with(col(x), self._pairs(), lambda v, p: F.try_divide(v - p["m"], p["s"]))

    def inverse(self, x: ColumnLike) -> Column:
        return F.zip_with(col(x), self._pairs(), lambda v, p: v * p["s"] + p["m"])


def channel_normalise(
    x: ColumnLike, mean: Sequence[float], std: Sequence[float], max_pixel_value: float = 255.0
) -> Column:
    """``(x / max - mean) / std`` per channel of an array of channel values."""
    scale = F.array(
        *[
            F.struct(F.lit(m * max_pixel_value).alias("m"), F.lit(s * max_pixel_value).alias("s"))
            for m, s in zip(mean, std, strict=True)
        ]
    )
    return F.zip_with(col(x), scale, lambda v, p: F.try_divide(v - p["m"], p["s"]))


def channel_denormalise_clip(
    x: ColumnLike, mean: Sequence[float], std: Sequence[float]
) -> Column:
    """Undo the normalisation and clip to [0, 1]."""
    scale = F.array(
        *[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(mean, std, strict=True)]
    )
    return F.zip_with(col(x), scale, lambda v, p: clamp(v * p["s"] + p["m"], 0, 1))
