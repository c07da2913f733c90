"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.llm.graph import components
from stridemill.llm.text import to_array
from stridemill.llm.vectors import padded, usable
from stridemill.schema import require_columns
from stridemill.session import stage

#: Nearest pivots that describe a vector, and how many two linked vectors must share.
NEAREST = 12
SHARED = 2
#: Fewest and most pivots (16 MB of 64 components); between them twice the square root of the number of vectors.
PIVOTS = (64, 1 << 15)
#: Least cosine under which linked vectors may appear from the mean.
LEAST_SEEN = 0.6
#: Candidates that are drawn for each pivot wanted.
CANDIDATES = 4
#: Members of an inverted list that meet in one task.
BLOCK = 2048


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    scaled = matrix / np.maximum(np.abs(matrix).max(1, initial=0, keepdims=True), 5e-324)
    return scaled / np.maximum(np.sqrt((scaled * scaled).sum(1, keepdims=True)), 5e-324)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest pivots of each vector, nearest first; ties to the smaller number."""
    count = min(count, len(pivots))
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :count].astype(np.int32)


def far_apart(candidates: np.ndarray, count: int, cosine: float) -> np.ndarray:
    """The first ``count`` candidates at less than ``cosine`` to all chosen before them."""
    chosen = np.zeros((min(count, len(candidates)), candidates.shape[1]))
    n = 0
    for point in candidates:
        if n == len(chosen):
            break
        if n == 0 or (chosen[:n] @ point).max() < cosine:
            chosen[n] = point
            n += 1
    return chosen[:n]


def choose_pivots(sample: np.ndarray, wanted: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The mean of a sample of unit vectors, and pivots among its directions from that mean.

    Seen from their mean, vectors that all point one way are as far apart as
    any. No two pivots lie within twice the angle under which linked vectors
    appear from there, so a hot group has few of them and its members are told
    by the same ones. Where links reach so far that hardly any pivots are left,
    the distance is halved until there are ``PIVOTS[0]`` of them. Where links
    reach so far that two linked vectors look unlike from the mean, directions
    are taken from the origin instead: that finds the links, but leaves more to
    compare.
    """
    center = sample.mean(0)
    apart = sample - center
    size = float(np.median(np.sqrt((apart * apart).sum(1))))
    seen = 1 - (1 - cosine) / max(size * size, 1e-12)  # the cosine of two linked directions
    if seen < LEAST_SEEN:
        center, apart, seen = np.zeros_like(center), sample, cosine
    limit = max(-1.0, 2 * max(seen, 0.0) ** 2 - 1)
    directions = _unit(apart)
    points = far_apart(directions, wanted, limit)
    while len(points) < min(wanted, PIVOTS[0]) and limit < 0.999:
        limit = (limit + 1) / 2
        points = far_apart(directions, wanted, limit)
    return center, points


def _describe(pivots: Broadcast, width: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vectors, sizes = padded(part.column("vector"), width)
                center, points = pivots.value
                order = nearest_pivots(_unit(_unit(vectors) - center), points, count)
                lists = np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("copies"),
                        pa.array(sizes.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(order.reshape(-1))),
                        to_array(vectors.reshape(-1).view(np.uint8), np.arange(len(order) + 1) * width * 8, pa.binary()),
                    ],
                    ["id", "copies", "size", "order", "vector"],
                )

    return run


def _linked(least: float, shared: int, width: int):
    """Verified links of one block pair of one inverted list.

    A pair meets in the list of every pivot that it shares; it is looked at
    only in the one with the smallest number, or in the part of it that belongs
    to the second smallest. Shared pivots are counted by one product of the
    membership matrices in which pivots that should not be shared here weigh
    1,000: a pair that shares one of them counts a million or more.
    """

    def run(table: pa.Table) -> pa.Table:
        pivot, second = (table.column(c)[0].as_py() for c in ("pivot", "second"))
        order = np.stack(table.column("order").to_numpy())
        side = table.column("side").to_numpy()
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        sizes = table.column("size").to_numpy()
        raw = table.column("vector").combine_chunks()
        vectors = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(ids), width)
        vectors = _unit(vectors)
        barred = (order < max(pivot, second)) & (order != pivot)
        weight = np.where(barred, 1000, 1).astype(np.float32)
        used, column = np.unique(order, return_inverse=True)  # members of a hot group have few pivots
        member = np.zeros((len(ids), len(used)), np.float32)
        member[np.arange(len(ids))[:, None], column.reshape(order.shape)] = weight
        if (side >= 0).any():
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        else:
            left = right = np.arange(len(ids))
        links, tree = np.zeros(len(ids), np.int64), np.arange(len(ids))
        forest: list[tuple[int, int]] = []

        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            counts = member[rows] @ member[right].T
            near = (counts >= shared) & (counts < 1_000_000) & (sizes[rows][:, None] == sizes[right])
            if left is right:
                near &= rows[:, None] < right
            a, b = np.nonzero(near)
            if len(a) > near.size // 20:
                alike = near & (vectors[rows] @ vectors[right].T >= least)
                a, b = np.nonzero(alike)
                a, b = rows[a], right[b]
            else:
                a, b = rows[a], right[b]
                cosine = np.concatenate(
                    [(vectors[a[k : k + 50_000]] * vectors[b[k : k + 50_000]]).sum(1) for k in range(0, len(a), 50_000)]
                ) if len(a) else np.zeros(0)
                a, b = a[cosine >= least], b[cosine >= least]
            links += np.bincount(a, copies[b], len(ids)).astype(np.int64)
            links += np.bincount(b, copies[a], len(ids)).astype(np.int64)
            # rows already of one tree need no link; the rest is few
            heads = np.flatnonzero(np.r_[np.ones(min(1, len(a)), bool), a[1:] != a[:-1]])
            for x, mates in zip(a[heads].tolist(), np.split(b, heads[1:])):
                mates = mates[tree[mates] != tree[x]]
                for other, k in zip(*(v.tolist() for v in np.unique(tree[mates], return_index=True))):
                    forest.append((x, int(mates[k])))
                    tree[tree == other] = tree[x]
        some = np.flatnonzero(links)
        ends = np.array(forest, np.int64).reshape(-1, 2)
        return pa.table(
            {
                "a": np.r_[ids[some], ids[ends[:, 0]]],
                "b": pa.array(np.r_[np.zeros(len(some), np.int64), ids[ends[:, 1]]], mask=np.r_[np.ones(len(some), bool), np.zeros(len(ends), bool)]),
                "links": np.r_[links[some], np.zeros(len(ends), np.int64)],
            },
            schema=_LINKS,
        )

    return run


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _meetings(described: DataFrame, shared: int, block: int) -> DataFrame:
    """Every vector once for each block pair of each list in which it may meet another one.

    Lists and their parts are counted by pivot numbers alone; these tables have
    one row for each pivot.
    """
    entries = described.withColumn("pivot", F.explode("order"))
    sizes = entries.groupBy("pivot").agg(F.count("*").alias("n")).where("n > 1")
    second = F.explode(F.filter("order", lambda p: p > F.col("pivot")))
    long = sizes.where(F.lit(shared >= 2) & (F.col("n") > block))
    parts = entries.select("pivot", "order").join(F.broadcast(long), "pivot").select("pivot", "n", second.alias("second"))
    parts = parts.groupBy("pivot", "n", "second").agg(F.count("*").alias("size"))
    work = F.sum(F.col("size").cast("double") * F.col("size"))
    parted = parts.groupBy("pivot", "n").agg(work.alias("work")).where(F.col("work") < F.col("n").cast("double") * F.col("n"))
    marked = sizes.join(parted.select("pivot", F.lit(True).alias("parted")), "pivot", "left").select(
        "pivot", F.coalesce("parted", F.lit(False)).alias("parted")
    )
    dealt = entries.join(F.broadcast(marked), "pivot").withColumn(
        "second",
        F.explode(
            F.when(F.col("parted"), F.filter("order", lambda p: p > F.col("pivot"))).otherwise(F.array(F.lit(-1)))
        ),
    )
    lists = dealt.groupBy("pivot", "second").agg(F.count("*").alias("n")).where("n > 1")
    lists = lists.select("pivot", "second", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = dealt.join(lists, ["pivot", "second"]).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "pivot", "second", "id", "copies", "size", "order", "vector",
        F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )


def linked_vectors(
    rows: DataFrame,
    vector: str = "embedding",
    id: str = "vec_id",
    cosine: float = 0.95,
    nearest: int = NEAREST,
    shared: int = SHARED,
    block: int = BLOCK,
) -> DataFrame:
    """``id``, ``n_links``, ``component_id``, ``kept`` for every row.

    Reference points (pivots) come from a sample of the distinct vectors, drawn
    by hash, and are directions from the sample's mean that lie well apart
    (``choose_pivots``): twice the square root of the number of vectors, at
    least 64. Each vector is described by its ``nearest`` pivots in order.
    Vectors that share ``shared`` of them meet in the inverted list of the
    smallest shared one and are linked if their cosine, in double precision, is
    ``cosine`` or more. Equal vectors are put together first and counted with
    their number. A list above ``block`` members is parted by the second shared
    pivot where that makes less to compare (nothing is lost, since two must be
    shared); lists that stay above ``block`` are cut into blocks that meet in
    pairs. Links are counted in the task and leave it as counts and a forest,
    never as all pairs. The index is approximate: linked pairs sharing too few
    pivots are missed (the tests hold the share found at 0.9 or more on groups,
    planted pairs and vectors that all point one way).

    Null, empty and zero vectors, and those with null or non-finite components,
    link with nothing and are their own component; so do vectors of different
    lengths. Rows of one id are one vector if they are equal; otherwise each
    counts, and the id's row shows the sum of both. A null id counts as the
    smallest id and comes back as null.
    """
    require_columns(rows, vector, id)
    if id in ("n_links", "component_id", "kept"):
        raise ValueError(f"the id column cannot be named {id}")
    spark = rows.sparkSession
    none = F.lit(-(2**63))
    key = F.coalesce(F.col(f"`{id}`").cast("long"), none)
    given = rows.select(key.alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    live = given.where(usable("vector") & F.exists("vector", lambda x: x != 0)).select(
        "id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")
    )
    distinct = stage(
        live.groupBy("h1", "h2").agg(
            F.min("id").alias("id"), F.count_distinct("id").alias("copies"), F.first("vector").alias("vector")
        ),
        "vectors",
    )
    total, width = distinct.agg(F.count("*"), F.max(F.size("vector"))).first()
    if total:
        wanted = int(min(max(PIVOTS[0], 2 * total**0.5), PIVOTS[1], total))
        drawn = distinct.orderBy(F.xxhash64("h1", "h2"), "id").limit(CANDIDATES * wanted).select("vector").toArrow()
        center, points = choose_pivots(_unit(padded(drawn.column("vector"), width)[0]), wanted, cosine)
        shared = min(shared, nearest, len(points))
        described = stage(
            distinct.select("id", "copies", "vector").mapInArrow(
                _describe(spark.sparkContext.broadcast((center, points)), width, nearest),
                "id LONG, copies LONG, size INT, order ARRAY<INT>, vector BINARY",
            ),
            "described",
        )
        met = _meetings(described, shared, block)
        found = stage(
            met.groupBy("pivot", "second", "x", "y").applyInArrow(
                _linked(cosine, shared, width), "a LONG, b LONG, links LONG"
            ),
            "links",
        )
    else:
        found = spark.createDataFrame([], "a LONG, b LONG, links LONG")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    groups = components(found.where("b IS NOT NULL"))
    each = distinct.join(counts, distinct["id"] == counts["a"], "left").join(groups, distinct["id"] == groups["node"], "left").select(
        "h1", "h2",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component", distinct["id"]).alias("component"),
    )
    per_id = live.select("id", "h1", "h2").distinct().join(each, ["h1", "h2"]).groupBy("id").agg(
        F.sum("links").alias("links"), F.min("component").alias("component")
    )
    out = given.select("id").join(per_id, "id", "left").select(
        "id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    plain = lambda c: F.when(F.col(c) != none, F.col(c))
    return out.select(
        plain("id").alias(id), "n_links", plain("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept")
    )
