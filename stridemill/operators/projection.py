"""Linear projections: PCA, truncated SVD, and classifiers on top of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.operators.combine import STATE, added, chunks, factored, triangular
from stridemill.operators.network import Classifier, classify, fit_classifier
from stridemill.operators.scaling import StandardArray
from stridemill.operators.scoring import dense
from stridemill.schema import ColumnLike, require_array

# Up to this width all directions are kept, and the result is exact after one pass.
WHOLE_WIDTH = 256
# Most passes that turn the directions towards the largest singular values, and when to stop.
PASSES, TOLERANCE = 20, 1e-9
# Numbers that are scored together.
SCORED = 1 << 22


def _score(matrix: np.ndarray, shift: np.ndarray, x: ColumnLike) -> Column:
    return dense([(matrix, shift)], x, batch_size=max(1, min(4096, SCORED // len(matrix))))


@dataclass(frozen=True)
class PcaModel:
    """Centred principal components; ``components`` has one column per latent."""

    mean: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def transform(self, df: DataFrame, x: str, z: str = "z") -> DataFrame:
        return df.withColumn(z, _score(self.components, -self.mean @ self.components, x))

    def inverse(self, z: ColumnLike) -> Column:
        return _score(self.components.T, self.mean, z)

    def reconstruct(self, df: DataFrame, x: str, output: str = "reconstruction") -> DataFrame:
        return self.transform(df, x, "__z").withColumn(output, self.inverse("__z")).drop("__z")


def _rows(batch: pa.RecordBatch, mean: np.ndarray) -> np.ndarray:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    if len(x) != batch.num_rows * len(mean):
        raise ValueError(f"vectors must have {len(mean)} numbers, none null")
    return x.reshape(-1, len(mean)) - mean


def _turned(rows: DataFrame, basis: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """All rows' ``x' (x basis)`` summed: the directions, drawn towards the large singular values."""
    shared = rows.sparkSession.sparkContext.broadcast((basis, mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, mean = shared.value
        total = np.zeros_like(basis)
        for batch in batches:
            x = _rows(batch, mean)
            total += x.T @ (x @ basis)
        yield from chunks(total.ravel())

    return added(rows.mapInArrow(run, STATE)).reshape(basis.shape)


def _triangle(rows: DataFrame, basis: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The triangular factor of the rows in the directions of ``basis``."""
    shared = rows.sparkSession.sparkContext.broadcast((basis, mean))
    width = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, mean = shared.value
        total = np.zeros((0, width))
        for batch in batches:
            total = triangular(np.vstack([total, _rows(batch, mean) @ basis]))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["state"])

    return factored(rows.mapInArrow(run, "state BINARY"), width)


def right_singular(
    df: DataFrame, x: str, k: int, mean: np.ndarray | None = None, seed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest singular values of the rows (less ``mean``) and their right vectors, one a column.

    The rows are seen in a few random directions, which every pass over the
    data turns towards the large singular values; a QR factor of the rows in
    these directions then gives values and vectors. Each task folds its rows
    into a d x l sum or an l x l triangle, and these are combined on the
    executors, so neither a d x d matrix nor the rows reach the driver. Vectors
    up to ``WHOLE_WIDTH`` keep all their directions: exact in one pass. Rows
    with a null vector are left out. Each vector's largest component is
    positive.
    """
    require_array(df, x)
    rows = df.where(F.col(x).isNotNull()).select(F.col(x).cast("array<double>").alias("x"))
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no rows to fit")
    d = first["d"]
    if not 1 <= k <= d:
        raise ValueError(f"k must be 1 to {d}")
    mean = np.zeros(d) if mean is None else mean
    directions = d if d <= WHOLE_WIDTH else min(d, k + max(k, 16))
    # an Arrow batch holds at most about SCORED numbers
    limit = max(1, min(10_000, SCORED // d))
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(limit))
    try:
        if directions == d:
            basis = np.eye(d)
        else:
            basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, directions)))[0]
            last = np.zeros(k)
            for _ in range(PASSES):
                turned = _turned(rows, basis, mean)
                values = np.sqrt(np.linalg.svd(turned, compute_uv=False)[:k])
                basis = np.linalg.qr(turned)[0]
                if np.abs(values - last).max() <= TOLERANCE * max(values[0], 1e-300):
                    break
                last = values
        _, values, turns = np.linalg.svd(_triangle(rows, basis, mean))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    vectors = basis @ turns[:k].T
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    return values[:k], vectors * np.where(signs == 0, 1, signs)


def fit_pca(df: DataFrame, x: str, k: int) -> PcaModel:
    """Components of the centred rows and their shares of the variance; vectors may be wide."""
    fitted = StandardArray.fit(df.where(F.col(x).isNotNull()), x)
    mean = np.array(fitted.mean)
    values, vectors = right_singular(df, x, k, mean)
    total = float(np.square(np.nan_to_num(fitted.std)).sum() * (fitted.count - 1))
    return PcaModel(mean, vectors, values**2 / total if total else np.zeros(k))


@dataclass(frozen=True)
class SvdModel:
    """Right singular vectors (d x k) and singular values, not centred."""

    components: np.ndarray
    singular_values: np.ndarray

    def transform(self, x: ColumnLike) -> Column:
        return _score(self.components, np.zeros(self.components.shape[1]), x)


def fit_svd(df: DataFrame, x: str, k: int = 3) -> SvdModel:
    values, vectors = right_singular(df, x, k)
    return SvdModel(vectors, values)


def covariance(df: DataFrame, x: str) -> DataFrame:
    """Sample covariance ``(i, j, value)`` of the elements, upper triangle.

    Each task folds its rows into one triangle of outer products of centred
    rows; the triangles are added on the executors.
    """
    require_array(df, x)
    fitted = StandardArray.fit(df, x)
    mean, n = np.array(fitted.mean), fitted.count
    if n < 2:
        raise ValueError("covariance needs at least two rows")
    upper = np.triu_indices(len(mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            centred = _rows(batch, mean)
            total += centred.T @ centred
        yield from chunks(total[upper])

    rows = df.where(F.col(x).isNotNull()).select(F.col(x).cast("array<double>").alias("x"))
    cells = pa.table({"i": upper[0], "j": upper[1], "value": added(rows.mapInArrow(run, STATE)) / (n - 1)})
    return df.sparkSession.createDataFrame(cells)


@dataclass(frozen=True)
class CompressedClassifier:
    """A projection to a few latents followed by the small classifier."""

    projection: PcaModel
    classifier: Classifier

    @staticmethod
    def fit(
        df: DataFrame, x: str, label: str, latents: int, hidden: int, classes: int, seed: int = 0
    ) -> CompressedClassifier:
        projection = fit_pca(df, x, latents)
        latent = projection.transform(df.select(x, label), x, "z")
        return CompressedClassifier(projection, fit_classifier(latent, "z", label, hidden, classes, seed))

    def transform(self, df: DataFrame, x: str, output: str = "prediction") -> DataFrame:
        return classify(self.classifier, self.projection.transform(df, x, "__z"), "__z", output).drop("__z")
