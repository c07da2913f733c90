"""Clustering of integer vectors around centroids, by zone maps along a Hilbert curve."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.llm.vectors import lists, usable
from stridemill.schema import require_columns
from stridemill.session import stage

#: Vectors of a block, bytes of a range of the curve, and bits of the curve's cells in each dimension.
BLOCK_ROWS = 256
RANGE_BYTES = 16 << 20
BITS = 3
#: Components beyond this are not taken: their squared distances would not fit 64 bits.
LARGEST = 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (below ``2**bits``), as rows of bytes in order.

    The cells' bits are turned, from the highest down, by the reflections and
    swaps that the curve makes inside each half; then they are Gray-decoded and
    dealt plane by plane.
    """
    x = cells.T.astype(np.uint32).copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q = np.uint32(1 << level)
        low = q - np.uint32(1)
        for i in range(n):
            high = (x[i] & q) != 0
            x[0] ^= np.where(high, low, np.uint32(0))
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= swap
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return lists(column)[0].reshape(-1, width).astype(np.int64)


def _bytes(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix of bytes."""
    rows = np.ascontiguousarray(rows)
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.tobytes())])


def whole_vectors(df: DataFrame, vector: str, id: str, width: int, scale: int) -> DataFrame:
    """``id`` and ``q`` (``floor(scale * x)`` of each component) of the vectors that can be used."""
    sound = usable(vector) & (F.size(f"`{vector}`") == width)
    whole = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(x.cast("double") * scale))
    small = F.forall("q", lambda x: F.abs(x) <= LARGEST)
    # an unusable vector is told before its components are turned into integers
    rows = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.when(sound, whole).alias("q"))
    return rows.where(F.col("q").isNotNull() & small)


def _bounds(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest component in each dimension; a row per dimension goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(width, np.iinfo(np.int64).max), np.full(width, np.iinfo(np.int64).min)
        for batch in batches:
            x = _matrix(batch.column("q"), width)
            if len(x):
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if (low <= high).all():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(low), pa.array(high)], ["d", "low", "high"])

    ends = vectors.select("q").mapInArrow(run, "d LONG, low LONG, high LONG")
    rows = ends.groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").toArrow()
    return rows.column("low").to_numpy(), rows.column("high").to_numpy()


def blocks(vectors: DataFrame, width: int, rows: int = BLOCK_ROWS, bits: int = BITS) -> DataFrame:
    """Vectors in blocks along a Hilbert curve, written once: ``ids``, ``data`` (32-bit
    integers, row by row) and the corners ``low`` and ``high`` of their box.

    The curve's cells are even between the smallest and largest component of
    each dimension. Vectors of equal place are dealt by a hash of their id, so
    copies of one vector do not gather in one range.
    """
    low, high = _bounds(vectors, width)
    step = np.maximum(high - low + 1, 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("q"), width)
            cells = ((x - low) * (1 << bits)) // step
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), _bytes(hilbert_keys(cells, bits)), _bytes(x.astype("<i4").view(np.uint8))],
                ["id", "place", "data"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data = pa.array([], pa.int64()), np.zeros((0, width), "<i4")

        def flush(n: int) -> pa.RecordBatch:
            nonlocal ids, data
            x = data[:n]
            made = pa.RecordBatch.from_arrays(
                [pa.array([ids[:n].to_pylist()], pa.list_(pa.int64()))]
                + [pa.array([part.tobytes()], pa.binary()) for part in (x, x.min(0), x.max(0))],
                ["ids", "data", "low", "high"],
            )
            ids, data = ids[n:], data[n:]
            return made

        for batch in batches:
            ids = pa.concat_arrays([ids, batch.column("id")])
            raw = b"".join(batch.column("data").to_pylist())
            data = np.concatenate([data, np.frombuffer(raw, "<i4").reshape(-1, width)])
            while len(data) >= rows:
                yield flush(rows)
        if len(data):
            yield flush(len(data))

    placed = vectors.mapInArrow(place, "id LONG, place BINARY, data BINARY")
    ranges = max(1, -(-vectors.count() * 4 * width // RANGE_BYTES))
    tie = F.xxhash64("id")
    dealt = placed.repartitionByRange(ranges, F.col("place"), tie).sortWithinPartitions(F.col("place"), tie)
    return stage(dealt.mapInArrow(cut, "ids ARRAY<LONG>, data BINARY, low BINARY, high BINARY"), "blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that may be nearest to a vector of the box.

    A centroid is left out if even its nearest point of the box is farther from
    it than the box's farthest point is from another centroid.
    """
    least = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    most = np.maximum(np.abs(low - centroids), np.abs(high - centroids))
    return np.flatnonzero((least * least).sum(1) <= (most * most).sum(1).min())


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances: by a product of matrices where 53 bits hold all sums, else in 64-bit integers."""
    top = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:
        a, c = x.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        out[:, k] = (d * d).sum(1)
    return out


def _nearest(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors, nearest centroid (ties: the smaller number) and squared distance, block by block."""
    width = centroids.shape[1]
    for ids, data, low, high in zip(*(batch.column(c).to_pylist() for c in ("ids", "data", "low", "high"))):
        x = np.frombuffer(data, "<i4").reshape(-1, width).astype(np.int64)
        box = [np.frombuffer(corner, "<i4").astype(np.int64) for corner in (low, high)]
        near = candidates(*box, centroids)
        d = distances(x, centroids[near])
        best = d.argmin(1)
        yield ids, x, near[best], d[np.arange(len(x)), best]


def _sums(table: DataFrame, centroids: np.ndarray) -> list:
    """Number and component sums of the vectors of each cluster that has any; a row per cluster and task."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for _, x, cluster, _ in _nearest(batch, centroids):
                counts += np.bincount(cluster, minlength=k)
                np.add.at(sums, cluster, x)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    parts = table.mapInArrow(run, "cluster INT, n LONG, sums ARRAY<LONG>")
    total = parts.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(
        F.sum("n").alias("n"), F.sum("col").alias("total")
    )
    return total.collect()


def _first(vectors: DataFrame, clusters: int, salt: str) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("q", order.alias("h")).orderBy("h", "q").limit(clusters).collect()
    return np.array([r["q"] for r in rows], np.int64)


def cluster_vectors(
    df: DataFrame,
    vector: str = "embedding",
    id: str = "vec_id",
    width: int = 64,
    clusters: int = 40,
    rounds: int = 5,
    scale: int = 256,
    salt: str = "2:",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every usable vector with its cluster after ``rounds`` of centroid clustering in integers.

    Vectors of ``width`` components, none null or not finite, become integers
    ``floor(scale * x)``; all others are left out, and so are vectors with an
    integer beyond 2**27, whose squared distance may not fit a long. The
    centroids start as the ``clusters`` vectors (fewer, if there are fewer)
    with the smallest sha256 of ``salt`` and id. In each round every vector
    goes to the nearest centroid (squared Euclidean distance, ties to the
    smaller number), and every centroid that has vectors becomes the floor of
    their mean. Then vectors are assigned once more.

    Vectors are written once in blocks along a Hilbert curve. The box around a
    block bounds the distance of its vectors to each centroid; only centroids
    that can be nearest are compared. A round sends one row of sums per task
    and cluster. Repeated ids are separate rows; a null id counts as empty text
    in the hash.

    Returns ``id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``
    and ``centroid`` (the components of the final centroid).
    """
    require_columns(df, vector, id)
    made = ["cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    if id in made:
        raise ValueError(f"the id column cannot be named {id}")
    spark = df.sparkSession
    vectors = whole_vectors(df, vector, id, width, scale)
    centroids = _first(vectors, clusters, salt)
    if not len(centroids):
        empty = f"`{id}` LONG, cluster INT, distance LONG, cluster_inertia LONG, inertia LONG, centroid ARRAY<LONG>"
        return spark.createDataFrame([], empty)
    table = blocks(vectors, width, block_rows)
    for _ in range(rounds):
        before = centroids.copy()
        for row in _sums(table, before):
            centroids[row["cluster"], row["pos"]] = row["total"] // row["n"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, cluster, distance in _nearest(batch, centroids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance)],
                    ["id", "cluster", "distance"],
                )

    rows = stage(table.mapInArrow(assign, "id LONG, cluster INT, distance LONG"), "assigned")
    # one row per cluster from here on
    own = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(own.values())
    facts = spark.createDataFrame(
        [(k, d, total, centroids[k].tolist()) for k, d in own.items()],
        "cluster INT, cluster_inertia LONG, inertia LONG, centroid ARRAY<LONG>",
    )
    return rows.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id), *made)


def centroid_digest(centroid: str = "centroid"):
    """Hexadecimal sha256 of the components as decimal integers, joined by commas."""
    return F.sha2(F.array_join(F.col(centroid).cast("array<string>"), ",").cast("binary"), 256)
