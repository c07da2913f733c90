"""Sums and triangular factors over all rows, put together on the executors before the driver sees them.

Every task folds its rows into one state. Long states are cut into chunks, so
that the states of all tasks are added chunk by chunk on many executors; what
the driver gets does not depend on the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Numbers of a chunk: an Arrow batch of 10,000 chunks has 80 MB.
CHUNK = 1024
STATE = "ix LONG, state BINARY"


def chunks(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A vector as rows of ``STATE``."""
    raw, step = np.ascontiguousarray(values), 256 * CHUNK
    for low in range(0, len(raw), step):
        parts = [raw[k : k + CHUNK].tobytes() for k in range(low, min(low + step, len(raw)), CHUNK)]
        ix = pa.array(np.arange(low // CHUNK, low // CHUNK + len(parts)))
        yield pa.RecordBatch.from_arrays([ix, pa.array(parts, pa.binary())], ["ix", "state"])


def added(states: DataFrame, kind: type = np.float64) -> np.ndarray:
    """The sum of the vectors of all tasks; none gives an empty vector.

    Integers are added exactly, in whatever order the states arrive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for ix, raw in zip(batch.column("ix").to_pylist(), batch.column("state").to_pylist()):
                part = np.frombuffer(raw, kind)
                total[ix] = total[ix] + part if ix in total else part
        if total:
            raw = pa.array([v.tobytes() for v in total.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), raw], ["ix", "state"])

    rows = sorted(states.repartition("ix").mapInArrow(run, STATE).collect())
    return np.concatenate([np.frombuffer(r["state"], kind) for r in rows]) if rows else np.zeros(0, kind)


def triangular(rows: np.ndarray) -> np.ndarray:
    """R of the QR factors of a tall matrix, as many rows as columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def factored(states: DataFrame, width: int) -> np.ndarray:
    """One triangular factor of all rows from those of the tasks (``state`` only), by stacking and factoring twice."""

    def fold(total: np.ndarray, raw: bytes) -> np.ndarray:
        return triangular(np.vstack([total, np.frombuffer(raw).reshape(-1, width)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, width))
        for batch in batches:
            for raw in batch.column("state").to_pylist():
                total = fold(total, raw)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["state"])

    groups = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = np.zeros((0, width))
    for row in states.repartition(groups).mapInArrow(run, "state BINARY").collect():
        total = fold(total, row["state"])
    return total
