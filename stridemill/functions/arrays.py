"""Column expressions over array columns: activations, layout, lookups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stridemill.schema import ColumnLike, col


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda body is evaluated per element, so an aggregate used inside
    ``transform`` has to be bound outside of it.
    """
    return F.get(F.transform(F.array(value), body), 0)


def indices(n: Column) -> Column:
    """``[0 .. n-1]``, empty for 0 (``sequence(0, -1)`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
        F.array().cast("array<int>")
    )


def array_sum(a: ColumnLike) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x)


def as_doubles(a: ColumnLike) -> Column:
    return col(a).cast("array<double>")


def argmax(a: ColumnLike) -> Column:
    """0-based index of the first maximum."""
    return F.array_position(col(a), F.array_max(col(a))).cast("int") - 1


def log_sum_exp(a: ColumnLike) -> Column:
    """Shifted by the maximum, so large logits do not overflow."""
    a = col(a)
    return let(
        F.array_max(a),
        lambda m: m
        + F.log(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))),
    )


def softmax(a: ColumnLike) -> Column:
    a = col(a)
    return let(log_sum_exp(a), lambda z: F.transform(a, lambda x: F.exp(x - z)))


def sigmoid(x: ColumnLike) -> Column:
    """Each branch only exponentiates a non-positive number."""
    x = col(x)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def relu(x: ColumnLike) -> Column:
    return F.greatest(col(x), F.lit(0.0))


def clamp(x: ColumnLike, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(float(low))), F.lit(float(high)))


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return array_sum(F.zip_with(col(a), col(b), lambda x, y: x * y))


def transpose(x: ColumnLike) -> Column:
    """Swap the two axes of an array of equally long arrays; ragged is an error."""

    def swap(m: Column) -> Column:
        ragged = F.exists(m, lambda r: F.size(r) != F.size(F.get(m, 0)))
        columns = F.transform(
            indices(F.size(F.get(m, 0))), lambda i: F.transform(m, lambda r: F.get(r, i))
        )
        return F.when(
            ragged, F.raise_error(F.lit("rows of an array to transpose differ in length"))
        ).when(F.size(m) == 0, F.filter(m, lambda r: F.lit(False))).otherwise(columns)

    return let(col(x), swap)


def stitch_channels(*channels: ColumnLike) -> Column:
    """One array per channel -> one array per time step."""
    return transpose(F.array(*[col(c) for c in channels]))


def flatten(x: ColumnLike) -> Column:
    return F.flatten(col(x))


def expand_dims(x: ColumnLike) -> Column:
    """Add a trailing axis of length 1: ``[a, b]`` -> ``[[a], [b]]``."""
    return F.transform(col(x), lambda v: F.array(v))


def unsqueeze(x: ColumnLike) -> Column:
    """Add a leading axis of length 1."""
    return F.array(col(x))


def squeeze(x: ColumnLike) -> Column:
    """Drop a leading axis; its length must be 1."""
    x = col(x)
    return F.when(F.size(x) == 1, F.get(x, 0)).otherwise(
        F.raise_error(F.lit("squeeze needs an axis of length 1"))
    )


def split_features(columns: Sequence[str]) -> tuple[Column, Column]:
    """``(features, label)``: the last column is the label."""
    if len(columns) < 2:
        raise ValueError("need at least one feature and one label column")
    return F.array(*[F.col(c).cast("double") for c in columns[:-1]]), F.col(columns[-1])


def pad_to(x: ColumnLike, length: ColumnLike, fill: float = 0.0) -> Column:
    """Right-pad with ``fill``."""
    x = col(x)
    return F.concat(x, F.array_repeat(F.lit(fill), F.greatest(col(length) - F.size(x), F.lit(0))))
