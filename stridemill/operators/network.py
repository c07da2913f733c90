"""A dense classifier with ReLU units, fitted on all rows by the gradients of every task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.functions.arrays import argmax
from stridemill.operators.combine import STATE, added, chunks
from stridemill.operators.scoring import MAX_WEIGHTS, Layers, check_layers, dense
from stridemill.schema import require_array, require_columns
from stridemill.session import stage

# Partial gradients of the mean loss are added as multiples of this: exactly, in any order.
UNIT = 2.0**-44


@dataclass(frozen=True)
class Classifier:
    """Dense layers, ReLU after all but the last, class scores at the end."""

    layers: Layers

    @property
    def width(self) -> int:
        return self.layers[0][0].shape[0]


def start(widths: Sequence[int], seed: int = 0) -> Layers:
    """Weights and biases even within ``1 / sqrt(inputs)``; the same for a seed everywhere."""
    rng = np.random.default_rng(seed)
    out = []
    for rows, cols in zip(widths, widths[1:]):
        bound = 1 / np.sqrt(rows)
        out.append((rng.uniform(-bound, bound, (rows, cols)), rng.uniform(-bound, bound, cols)))
    return out


def _flat(layers: Layers) -> np.ndarray:
    return np.concatenate([p.ravel() for layer in layers for p in layer])


def _shaped(values: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for w, b in like:
        out.append((values[at : at + w.size].reshape(w.shape), values[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def loss_and_gradient(layers: Layers, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cross-entropy summed over the rows, followed by its gradient by all weights and biases."""
    inputs = [x]
    for k, (w, b) in enumerate(layers):
        z = inputs[-1] @ w + b
        inputs.append(np.maximum(z, 0) if k + 1 < len(layers) else z)
    z = inputs.pop()
    z = z - z.max(1, keepdims=True)
    total = np.exp(z).sum(1, keepdims=True)
    rows = np.arange(len(y))
    delta = np.exp(z) / total
    delta[rows, y] -= 1
    parts = []
    for (w, _), a in zip(reversed(layers), reversed(inputs)):
        parts += [delta.sum(0), (a.T @ delta).ravel()]
        delta = (delta @ w.T) * (a > 0)  # at the inputs of the next layer down
    loss = (np.log(total[:, 0]) - z[rows, y]).sum()
    return np.concatenate([[loss], *reversed(parts)])


class _Rows:
    """Features and labels written once, and the mean loss with its gradient over all of them."""

    def __init__(self, df: DataFrame, x: str, label: str, layers: Layers):
        require_columns(df, x, label)
        require_array(df, x)
        check_layers(layers)
        if sum(w.size + b.size for w, b in layers) > MAX_WEIGHTS:
            raise ValueError(f"more than {MAX_WEIGHTS} weights")
        known = F.col(x).isNotNull() & F.col(label).isNotNull()
        rows = df.where(known).select(F.col(x).cast("array<double>").alias("x"), F.col(label).cast("long").alias("y"))
        self.rows, self.like = stage(rows, "training"), layers
        self.n = self.rows.count()
        if not self.n:
            raise ValueError("no rows to fit")

    def __call__(self, point: np.ndarray) -> tuple[float, np.ndarray]:
        layers, n, unit = _shaped(point, self.like), self.n, UNIT
        width, classes = layers[0][0].shape[0], layers[-1][0].shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
                y = batch.column("y").to_numpy()
                if len(x) != width * len(y):
                    raise ValueError(f"vectors must have {width} numbers")
                if y.min() < 0 or y.max() >= classes:
                    raise ValueError(f"labels must be 0 to {classes - 1}")
                total = total + loss_and_gradient(layers, x.reshape(-1, width), y)
            if not np.isscalar(total):
                yield from chunks(np.round(total / (n * unit)).astype(np.int64))

        both = added(self.rows.mapInArrow(run, STATE), np.int64) * unit
        return both[0], both[1:]


def _nesterov(f, point: np.ndarray, steps: int, rate: float, momentum: float) -> np.ndarray:
    speed = np.zeros_like(point)
    for _ in range(steps):
        speed = momentum * speed - rate * f(point + momentum * speed)[1]
        point = point + speed
    return point


def _lbfgs(f, point: np.ndarray, steps: int, memory: int = 10, tolerance: float = 1e-7) -> np.ndarray:
    """Limited-memory quasi-Newton steps, each shortened until the loss falls enough."""
    loss, slope = f(point)
    known: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max() < tolerance:
            break
        way, weights = slope.copy(), []
        for s, y in reversed(known):
            a = s @ way / (s @ y)
            weights.append(a)
            way -= a * y
        if known:
            s, y = known[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, np.abs(slope).sum())
        for (s, y), a in zip(known, reversed(weights)):
            way += s * (a - (y @ way) / (s @ y))
        fall, size = -(slope @ way), 1.0
        for _ in range(20):
            further = point - size * way
            new_loss, new_slope = f(further)
            if new_loss <= loss + 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        s, y = further - point, new_slope - slope
        if s @ y > 1e-12 * (y @ y):
            known = [*known[-(memory - 1) :], (s, y)]
        done = loss - new_loss < tolerance * max(1.0, abs(loss))
        point, loss, slope = further, new_loss, new_slope
        if done:
            break
    return point


def train(
    df: DataFrame,
    x: str,
    label: str,
    layers: Layers,
    steps: int = 50,
    method: str = "lbfgs",
    rate: float = 0.1,
    momentum: float = 0.9,
) -> Classifier:
    """Fit from given layers on all rows; a step is one pass (``lbfgs``: one or a few).

    Every task sums the gradient of its rows over Arrow batches; the sums are
    added as integers on the executors, so they do not depend on the order in
    which tasks end. ``method`` is ``lbfgs`` or ``nesterov`` (with ``rate`` and
    ``momentum``). Rows with a null vector or label are left out; a label that
    is no class is an error.
    """
    if method not in ("lbfgs", "nesterov"):
        raise ValueError("method must be 'lbfgs' or 'nesterov'")
    f, point = _Rows(df, x, label, layers), _flat(layers)
    point = _lbfgs(f, point, steps) if method == "lbfgs" else _nesterov(f, point, steps, rate, momentum)
    return Classifier(_shaped(point, layers))


def fit_classifier(
    df: DataFrame, x: str, label: str, hidden: int, classes: int, seed: int = 0, max_iter: int = 50
) -> Classifier:
    """Two hidden layers of one width, ReLU units, from a start that depends on the seed only."""
    require_columns(df, x, label)
    first = df.where(F.col(x).isNotNull()).select(F.size(x).alias("n")).first()
    if first is None:
        raise ValueError("no rows to fit")
    return train(df, x, label, start([first["n"], hidden, hidden, classes], seed), max_iter)


def classify(model: Classifier, df: DataFrame, x: str, output: str = "prediction") -> DataFrame:
    """The class of the largest score; ties go to the smaller class."""
    scored = df.withColumn("__scores", dense(model.layers, x))
    return scored.withColumn(output, argmax("__scores").cast("int")).drop("__scores")
