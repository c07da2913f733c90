"""Row-level losses as column expressions, and their reduction.

Image-shaped inputs are one row per pixel: ``logits ARRAY<DOUBLE>`` over the
classes and an integer ``target``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.functions.arrays import let, log_sum_exp, sigmoid
from stridemill.schema import ColumnLike, col, names

ONE_HOT_EPS = 1e-6
LOSS_EPS = 1e-8

REDUCTIONS = ("none", "mean", "sum")


def check_reduction(how: str) -> str:
    if how not in REDUCTIONS:
        raise ValueError(f"unknown reduction {how!r}, expected one of {REDUCTIONS}")
    return how


def reduce_loss(
    df: DataFrame, loss: str = "loss", how: str = "mean", by: str | list[str] = ()
) -> DataFrame:
    """``none`` keeps the rows; ``mean`` and ``sum`` aggregate, per group if asked."""
    check_reduction(how)
    if how == "none":
        return df
    value = F.avg(loss) if how == "mean" else F.sum(loss)
    keys = names(by)
    return (df.groupBy(*keys) if keys else df).agg(value.alias(loss))


def squared_error(output: ColumnLike, target: ColumnLike) -> Column:
    d = col(output) - col(target)
    return d * d


def squared_error_sum(output: ColumnLike, target: ColumnLike) -> Column:
    """Sum over the elements of two equally long arrays; unequal length is an error."""
    a, b = col(output), col(target)
    total = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x
    )
    return F.when(F.size(a) == F.size(b), total).otherwise(
        F.raise_error(F.lit("prediction and target differ in length"))
    )


def class_logit(logits: ColumnLike, target: ColumnLike) -> Column:
    """The target's logit; a target outside the classes is an error."""
    logits, target = col(logits), col(target)
    known = (target >= 0) & (target < F.size(logits))
    return F.when(target.isNull() | known, F.get(logits, target.cast("int"))).otherwise(
        F.raise_error(F.lit("target outside the class range"))
    )


def cross_entropy(logits: ColumnLike, target: ColumnLike) -> Column:
    return log_sum_exp(logits) - class_logit(logits, target)


def one_hot(label: ColumnLike, num_classes: int, eps: float = ONE_HOT_EPS) -> Column:
    """1 at the label and 0 elsewhere, with ``eps`` added to every class."""
    if num_classes < 1:
        raise ValueError("num_classes must be at least 1")
    label = col(label)
    return F.transform(
        F.sequence(F.lit(0), F.lit(num_classes - 1)),
        lambda i: F.when(i == label, 1.0).otherwise(0.0) + F.lit(eps),
    )


def class_probability(logits: ColumnLike, target: ColumnLike) -> Column:
    return F.exp(class_logit(logits, target) - log_sum_exp(logits))


def dice_overlap(logits: ColumnLike, target: ColumnLike) -> Column:
    """Per pixel: sum over classes of probability times one-hot target.

    The probabilities sum to 1, so this is the target's probability plus the
    one-hot eps; no per-class array is built.
    """
    return class_probability(logits, target) + ONE_HOT_EPS


def dice_mass(logits: ColumnLike) -> Column:
    """Per pixel: sum over classes of probability plus one-hot target."""
    return 2.0 + ONE_HOT_EPS * F.size(col(logits))


def focal_pixel(
    logits: ColumnLike, target: ColumnLike, alpha: float, gamma: float = 2.0, eps: float = LOSS_EPS
) -> Column:
    """Per pixel: one-hot weighted sum over classes of the focal term.

    ``1 - (p + eps)`` can fall just below 0, where a fractional power is NaN,
    so it is clamped at 0.
    """
    logits = col(logits)

    def term(q: Column) -> Column:
        return -alpha * F.pow(F.greatest(1.0 - q, F.lit(0.0)), F.lit(gamma)) * F.log(q)

    def over_classes(z: Column) -> Column:
        everywhere = F.aggregate(
            logits, F.lit(0.0), lambda acc, x: acc + term(F.exp(x - z) + eps)
        )
        hit = term(F.exp(class_logit(logits, target) - z) + eps)
        return hit + ONE_HOT_EPS * everywhere

    return let(log_sum_exp(logits), over_classes)


def binary_focal(
    logit: ColumnLike,
    target: ColumnLike,
    alpha: float = 0.25,
    gamma: float = 2.0,
    eps: float = LOSS_EPS,
) -> Column:
    p, t = sigmoid(logit), col(target)
    hit = -alpha * F.pow(1.0 - p + eps, F.lit(gamma)) * t * F.log(p + eps)
    miss = (1 - alpha) * F.pow(p + eps, F.lit(gamma)) * (1.0 - t) * F.log(1.0 - p + eps)
    return hit - miss


def kl_sum(mean: ColumnLike, logvar: ColumnLike) -> Column:
    """Per row: sum over the latents of ``1 + logvar - mean^2 - exp(logvar)``."""
    return F.aggregate(
        F.zip_with(col(mean), col(logvar), lambda m, v: 1 + v - m * m - F.exp(v)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
