"""Batch scoring of rows with dense layers held in a weight table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridemill.functions.arrays import argmax
from stridemill.functions.metrics import Metric, evaluate
from stridemill.functions.scalars import hash_normal, row_hash
from stridemill.schema import WEIGHTS, ColumnLike, col, names, require_array, require_columns

Layers = list[tuple[np.ndarray, np.ndarray]]

# A weight table is a model, collected to the driver; refuse anything larger.
MAX_WEIGHTS = 50_000_000


def write_weights(spark: SparkSession, layers: Layers, path: str) -> None:
    """Store layers as ``(layer, weight[in][out], bias[out])``."""
    rows = [
        (i, [[float(v) for v in r] for r in w], [float(v) for v in b])
        for i, (w, b) in enumerate(layers)
    ]
    spark.createDataFrame(rows, WEIGHTS).write.mode("overwrite").parquet(path)


def load_weights(table: DataFrame) -> Layers:
    """Collect a weight table after checking how many numbers it holds."""
    require_columns(table, "layer", "weight", "bias")
    size = table.agg(F.sum(F.size(F.flatten("weight")) + F.size("bias"))).first()[0] or 0
    if size == 0:
        raise ValueError("empty weight table")
    if size > MAX_WEIGHTS:
        raise ValueError(f"{size} weights, more than {MAX_WEIGHTS}")
    rows = table.orderBy("layer").collect()
    return [(np.array(r["weight"], dtype=float), np.array(r["bias"], dtype=float)) for r in rows]


def check_layers(layers: Layers) -> None:
    if not layers:
        raise ValueError("no layers")
    for i, (w, b) in enumerate(layers):
        if w.ndim != 2 or b.shape != (w.shape[1],):
            raise ValueError(f"layer {i}: weight {w.shape} and bias {b.shape} do not fit")
        if i and layers[i - 1][0].shape[1] != w.shape[0]:
            raise ValueError(f"layer {i} takes {w.shape[0]} inputs, gets {layers[i - 1][0].shape[1]}")


def autoencoder_widths(input_dim: int, latent_dim: int) -> list[int]:
    """Layer widths: halved twice, the latent, and back."""
    return [
        input_dim, input_dim // 2, input_dim // 4, latent_dim,
        input_dim // 4, input_dim // 2, input_dim,
    ]


def forward(layers: Layers, relu_after: Sequence[bool], x: np.ndarray) -> np.ndarray:
    for (weight, bias), active in zip(layers, relu_after):
        x = x @ weight + bias
        if active:
            x = np.maximum(x, 0.0)
    return x


def dense(
    layers: Layers, x: ColumnLike, relu_after: Sequence[bool] | None = None, batch_size: int = 4096
) -> Column:
    """Dense stack over an array column, Arrow batches into numpy.

    ReLU follows every layer but the last unless ``relu_after`` says otherwise.
    """
    check_layers(layers)
    active = list(relu_after or [True] * (len(layers) - 1) + [False])
    if len(active) != len(layers):
        raise ValueError("relu_after needs one flag per layer")
    width = layers[0][0].shape[0]

    def make_predict():
        return lambda batch: forward(layers, active, batch)

    score = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    return score(col(x).cast("array<double>"))


def encode(layers: Layers, x: ColumnLike, batch_size: int = 4096) -> Column:
    """The encoder half of an auto-encoder stack: its first three layers."""
    return dense(layers[: len(layers) // 2], x, batch_size=batch_size)


def autoencode(layers: Layers, x: ColumnLike, batch_size: int = 4096) -> Column:
    """Reconstruction: no ReLU after the latent and the output layer."""
    half = len(layers) // 2
    relu = [i not in (half - 1, len(layers) - 1) for i in range(len(layers))]
    return dense(layers, x, relu, batch_size)


def score_rows(
    df: DataFrame,
    make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
    x: str,
    width: int,
    output: str = "prediction",
    batch_size: int = 4096,
) -> DataFrame:
    """Score an array column with the user's model, loaded once per worker."""
    require_array(df, x)
    predict = predict_batch_udf(
        make_predict_fn,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    return df.withColumn(output, predict(F.col(x).cast("array<double>")))


def predictions(
    df: DataFrame, prediction: str, target: str, classification: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """``(prediction, target)``; class scores become the index of the largest."""
    require_columns(df, prediction, target, *keep)
    value = argmax(prediction) if classification else F.col(prediction)
    return df.select(*keep, value.alias("prediction"), F.col(target).alias("target"))


def score_report(
    df: DataFrame,
    metrics: Sequence[str | Metric],
    prediction: str = "prediction",
    target: str = "target",
    by: str | Sequence[str] = (),
) -> DataFrame:
    """All metrics of a scored table in one aggregate."""
    return evaluate(df, metrics, prediction, target, names(by))


def for_each_batch(
    df: DataFrame, consume: Callable[[pd.DataFrame], None], batch_size: int
) -> int:
    """Hand the rows to ``consume`` in batches, inside the tasks; returns the row count.

    Nothing passes through the driver. A task that is run again hands over its
    rows again, so ``consume`` should overwrite rather than add.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, seen = None, 0
        for pdf in parts:
            seen += len(pdf)
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            while len(rest) >= batch_size:
                consume(rest.iloc[:batch_size])
                rest = rest.iloc[batch_size:]
        if rest is not None and len(rest):
            consume(rest)
        yield pd.DataFrame({"n": [seen]})

    return df.mapInPandas(run, "n LONG").agg(F.sum("n")).first()[0] or 0


def latent_sample(
    mean: ColumnLike,
    logvar: ColumnLike,
    ids: Sequence[ColumnLike],
    training: bool = True,
    seed: int = 0,
) -> Column:
    """``mean + noise * exp(logvar / 2)``, or the mean when scoring.

    The noise is a function of the row's ids, the latent index and the seed, so
    a recomputed task draws the same numbers.
    """
    mean, logvar = col(mean), col(logvar)
    if not training:
        return mean
    digest = row_hash(ids, seed)
    pairs = F.arrays_zip(mean.alias("m"), logvar.alias("v"))
    return F.transform(
        pairs,
        lambda p, i: p["m"]
        + hash_normal(F.md5(F.concat_ws(":", digest, i.cast("string")))) * F.exp(p["v"] / 2),
    )
