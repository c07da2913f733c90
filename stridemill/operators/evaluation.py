"""Losses and metrics over prediction tables, reduced per batch, epoch or image."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemill.functions import losses
from stridemill.functions.metrics import State
from stridemill.schema import ColumnLike, col, names, require_array, require_columns, require_integral

BATCH_KEYS = ("phase", "epoch", "loader_ix", "batch_ix")
EPOCH_KEYS = ("phase", "epoch")


def confusion_matrix(
    df: DataFrame, y_true: ColumnLike, y_pred: ColumnLike, num_classes: int
) -> DataFrame:
    """Dense counts ``(y_true, y_pred, n)`` over classes 0..k-1, zero cells kept.

    Pairs outside the class list are not counted.
    """
    if num_classes < 1:
        raise ValueError("num_classes must be at least 1")
    k = F.lit(num_classes)
    cells = df.sparkSession.range(num_classes * num_classes).select(
        F.floor(F.col("id") / k).alias("y_true"), F.pmod("id", k).alias("y_pred")
    )
    counts = (
        df.select(col(y_true).cast("long").alias("y_true"), col(y_pred).cast("long").alias("y_pred"))
        .groupBy("y_true", "y_pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return cells.join(counts, ["y_true", "y_pred"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def normalise_rows(confusion: DataFrame) -> DataFrame:
    """Share of each true class; a class without rows gives NULL."""
    row = Window.partitionBy("y_true")  # at most one row per class
    return confusion.withColumn("share", F.try_divide("n", F.sum("n").over(row)))


def batch_loss(
    df: DataFrame, loss: str = "loss", by: Sequence[str] = BATCH_KEYS
) -> DataFrame:
    """Mean loss over the rows of each batch, with the row count."""
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n"))


def epoch_loss(
    df: DataFrame,
    loss: str = "loss",
    weighting: str = "element",
    by: Sequence[str] = EPOCH_KEYS,
    batch: Sequence[str] = BATCH_KEYS,
) -> DataFrame:
    """``element``: mean over rows. ``batch``: unweighted mean of batch means."""
    if weighting == "element":
        return df.groupBy(*by).agg(F.avg(loss).alias("loss"))
    if weighting == "batch":
        return batch_loss(df, loss, batch).groupBy(*by).agg(F.avg("loss").alias("loss"))
    raise ValueError("weighting must be 'element' or 'batch'")


def epoch_means(
    batches: DataFrame, loss: str = "loss", n: str = "n", by: Sequence[str] = EPOCH_KEYS
) -> DataFrame:
    """Both reductions of a batch table: over rows, and over batch means."""
    return batches.groupBy(*by).agg(
        F.try_divide(F.sum(F.col(loss) * F.col(n)), F.sum(n)).alias("element_loss"),
        F.avg(loss).alias("batch_loss"),
    )


def weighted_epoch(
    batches: DataFrame, loss: str = "loss", n: str = "n", correct: str | None = None,
    by: Sequence[str] = EPOCH_KEYS,
) -> DataFrame:
    """Batch losses weighted by size, and accuracy = correct / rows."""
    outputs = [F.try_divide(F.sum(F.col(loss) * F.col(n)), F.sum(n)).alias("loss")]
    if correct:
        outputs.append(F.try_divide(F.sum(correct), F.sum(n)).alias("accuracy"))
    return batches.groupBy(*by).agg(*outputs)


def _pixels(df: DataFrame, sample: Sequence[str], logits: str, target: str) -> DataFrame:
    require_columns(df, *sample)
    require_array(df, logits)
    require_integral(df, target)
    return df.select(*sample, F.col(logits).cast("array<double>").alias("z"), F.col(target).alias("t"))


def _dice(eps: float) -> Column:
    return 1.0 - 2.0 * F.sum("overlap") / (F.sum("mass") + eps)


def dice_loss(
    df: DataFrame,
    sample: str | Sequence[str],
    logits: str = "logits",
    target: str = "target",
    reduction: str = "mean",
    eps: float = losses.LOSS_EPS,
) -> DataFrame:
    """One loss per image, then reduced. Input is one row per pixel."""
    losses.check_reduction(reduction)
    sample = names(sample)
    per_pixel = _pixels(df, sample, logits, target).select(
        *sample, losses.dice_overlap("z", "t").alias("overlap"), losses.dice_mass("z").alias("mass")
    )
    per_sample = per_pixel.groupBy(*sample).agg(_dice(eps).alias("loss"))
    return losses.reduce_loss(per_sample, "loss", reduction)


def focal_loss(
    df: DataFrame,
    sample: str | Sequence[str],
    alpha: float,
    gamma: float = 2.0,
    logits: str = "logits",
    target: str = "target",
    reduction: str = "none",
    eps: float = losses.LOSS_EPS,
) -> DataFrame:
    """Mean over the pixels of an image, then reduced over the images."""
    losses.check_reduction(reduction)
    sample = names(sample)
    per_pixel = _pixels(df, sample, logits, target).select(
        *sample, losses.focal_pixel("z", "t", alpha, gamma, eps).alias("loss")
    )
    per_sample = per_pixel.groupBy(*sample).agg(F.avg("loss").alias("loss"))
    return losses.reduce_loss(per_sample, "loss", reduction)


def image_losses(
    df: DataFrame,
    sample: str | Sequence[str],
    alpha: float,
    gamma: float = 2.0,
    logits: str = "logits",
    target: str = "target",
) -> DataFrame:
    """``(sample, focal, dice)`` per image, in one pass over the pixels."""
    sample = names(sample)
    per_pixel = _pixels(df, sample, logits, target).select(
        *sample,
        losses.dice_overlap("z", "t").alias("overlap"),
        losses.dice_mass("z").alias("mass"),
        losses.focal_pixel("z", "t", alpha, gamma).alias("focal"),
    )
    return per_pixel.groupBy(*sample).agg(
        F.avg("focal").alias("focal"), _dice(losses.LOSS_EPS).alias("dice")
    )


def mixed_loss(
    df: DataFrame,
    sample: str | Sequence[str],
    logits: str = "logits",
    target: str = "target",
    gamma: float = 1.1,
    alpha: float = 0.48,
    reduction: str = "mean",
) -> DataFrame:
    """Focal loss minus the logarithm of the dice loss, each reduced first.

    A dice loss of 0 gives +inf.
    """
    losses.check_reduction(reduction)
    out = image_losses(df, sample, alpha, gamma, logits, target)
    if reduction != "none":
        fold = F.avg if reduction == "mean" else F.sum
        out = out.agg(fold("focal").alias("focal"), fold("dice").alias("dice"))
    log_dice = F.when(F.col("dice") == 0, F.lit(float("-inf"))).otherwise(F.log("dice"))
    return out.withColumn("loss", F.col("focal") - log_dice).drop("focal", "dice")


def kl_divergence(
    df: DataFrame, mean: str = "mean", logvar: str = "logvar", by: str | Sequence[str] = ()
) -> DataFrame:
    """``-1/2`` times the mean of ``1 + logvar - mean^2 - exp(logvar)`` over all elements."""
    require_array(df, mean, logvar)
    return df.groupBy(*names(by)).agg(_kl(mean, logvar).alias("kl"))


def _kl(mean: str, logvar: str) -> Column:
    return -0.5 * F.try_divide(F.sum(losses.kl_sum(mean, logvar)), F.sum(F.size(mean)))


def joint_loss(
    df: DataFrame,
    output: str,
    target: str,
    mean: str = "mean",
    logvar: str = "logvar",
    reduction: str = "sum",
    by: str | Sequence[str] = (),
) -> DataFrame:
    """KL term plus squared reconstruction error, in one aggregate."""
    if losses.check_reduction(reduction) == "none":
        raise ValueError("a joint loss needs reduction 'mean' or 'sum'")
    require_array(df, output, target, mean, logvar)
    squared = F.sum(losses.squared_error_sum(output, target))
    if reduction == "mean":
        squared = F.try_divide(squared, F.sum(F.size(target)))
    return df.groupBy(*names(by)).agg(
        _kl(mean, logvar).alias("kl"), squared.alias("reconstruction")
    ).withColumn("loss", F.col("kl") + F.col("reconstruction"))


CRITERIA: dict[str, Callable[[Column, Column], Column]] = {
    "squared_error": losses.squared_error,
    "cross_entropy": losses.cross_entropy,
    "binary_focal": losses.binary_focal,
}


def apply_criterion(
    df: DataFrame,
    criterion: str | Callable[[Column, Column], Column],
    output: ColumnLike = "prediction",
    target: ColumnLike = "target",
    column: str = "loss",
) -> DataFrame:
    """Add a row loss: a registered name or the user's function of two columns.

    A function may return a built-in expression or call a ``pandas_udf``.
    """
    if isinstance(criterion, str):
        if criterion not in CRITERIA:
            raise ValueError(f"unknown criterion {criterion!r}, expected one of {sorted(CRITERIA)}")
        criterion = CRITERIA[criterion]
    return df.withColumn(column, criterion(col(output), col(target)))


def batch_metric(
    df: DataFrame,
    update: Callable[[pd.Series, pd.Series], dict[str, float]],
    states: Sequence[str],
    finish: Callable[[State], Column],
    yhat: str = "prediction",
    y: str = "target",
    by: str | Sequence[str] = (),
    name: str = "metric",
) -> DataFrame:
    """A user metric whose state is updated in Python and merged by sum.

    ``update`` sees one Arrow batch of one group at a time and returns partial
    states, so no group has to fit into a task.
    """
    keys = names(by)
    require_columns(df, *keys, yhat, y)
    states = list(states)
    rows = df.select(*keys, F.col(yhat).alias("__p"), F.col(y).alias("__t"))
    fields = [rows.schema[k].simpleString().split(":", 1) for k in keys]
    schema = ", ".join([f"`{k}` {t}" for k, t in fields] + [f"`{s}` double" for s in states])

    def partials(parts):
        for pdf in parts:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            out = []
            for key, group in groups:
                values = update(group["__p"], group["__t"])
                out.append([*key, *[float(values[s]) for s in states]])
            yield pd.DataFrame(out, columns=[*keys, *states])

    merged = rows.mapInPandas(partials, schema).groupBy(*keys).agg(*[F.sum(s).alias(s) for s in states])
    return merged.select(*keys, finish({s: F.col(s) for s in states}).alias(name))
