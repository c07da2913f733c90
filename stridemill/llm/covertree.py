"""Exact top-k by inner product: cover trees over queries and data, searched together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemill.llm.vectors import by_length, usable
from stridemill.schema import require_columns

#: Rows that a task indexes at a time, and bytes of queries that are broadcast at a time.
BLOCK = 4096
QUERY_BYTES = 16 << 20
LEAF = 256
QUERY_LEAF = 32
CHILDREN = 16
_MOST = 2**63 - 1


@dataclass
class Node:
    """Rows within ``radius`` of the vector ``center``; a leaf has no children."""

    center: np.ndarray
    norm: float
    radius: float
    rows: np.ndarray
    children: list["Node"]


def _distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - center) ** 2).sum(1))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree by farthest-first centers.

    A node's first child has the node's own center (nesting). Further centers
    are the rows farthest from those chosen, until the covering radius has
    halved or there are ``CHILDREN``: every row lies within that radius of its
    center, and the centers are at least that far apart.
    """

    def grow(rows: np.ndarray, center: int, distance: np.ndarray) -> Node:
        radius = float(distance.max())
        node = Node(points[center], float(np.sqrt((points[center] ** 2).sum())), radius, rows, [])
        if len(rows) <= leaf or radius == 0:
            return node
        centers, owner, near = [center], np.zeros(len(rows), np.int64), distance.copy()
        while len(centers) < CHILDREN and near.max() > radius / 2:
            far = rows[int(near.argmax())]
            d = _distances(points[rows], points[far])
            closer = d < near
            owner[closer], near = len(centers), np.minimum(near, d)
            centers.append(far)
        for k, c in enumerate(centers):
            mine = owner == k
            node.children.append(grow(rows[mine], int(c), near[mine]))
        return node

    everything = np.arange(len(points))
    return grow(everything, 0, _distances(points, points[0]))


class TopK:
    """The best ``k`` (score, id) of every query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), _MOST)

    def merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of candidates (columns) for some queries (rows); -inf is no candidate.

        Only queries and candidates with a score as high as the query's k-th
        one are sorted in.
        """
        high = (scores >= self.scores[rows, -1][:, None]) & (scores > -np.inf)
        some, columns = high.any(1), high.any(0)
        if not some.any():
            return
        rows, scores, ids = rows[some], scores[np.ix_(some, columns)], ids[columns]
        all_scores = np.concatenate([self.scores[rows], scores], 1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], 1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(all_scores, order, 1)
        self.ids[rows] = np.take_along_axis(all_ids, order, 1)

    def worst(self, rows: np.ndarray) -> float:
        return float(self.scores[rows, -1].min())


def search(tree: Node, data: np.ndarray, ids: np.ndarray, queries: Node, points: np.ndarray, own: np.ndarray, best: TopK) -> None:
    """Both trees downwards in pairs of nodes, best bound first.

    No inner product of rows of two nodes exceeds q.d + |q| s + |d| r + r s for
    centers q, d and radii r, s. A pair whose bound is below the worst k-th
    score among the node's queries is left out; a bound that only equals it is
    followed because of ties. Before that, every group of queries goes straight
    down to its most promising leaf, so that there are scores to prune with.
    """
    seen: set[tuple[int, int]] = set()

    def bound(q: Node, d: Node) -> float:
        reach = (q.norm + q.radius) * (d.norm + d.radius)
        return float(q.center @ d.center) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius + 1e-9 * reach

    def compare(q: Node, d: Node) -> None:
        if (id(q), id(d)) in seen:
            return
        seen.add((id(q), id(d)))
        scores = points[q.rows] @ data[d.rows].T
        scores = np.where(own[q.rows][:, None] == ids[d.rows], -np.inf, scores)
        best.merge(q.rows, scores, ids[d.rows])

    def descend(q: Node, d: Node) -> None:
        if q.children:
            for child in q.children:
                descend(child, d)
            return
        while d.children:
            d = max(d.children, key=lambda c: bound(q, c))
        compare(q, d)

    def visit(q: Node, d: Node, most: float) -> None:
        if most < best.worst(q.rows):
            return
        if not q.children and not d.children:
            compare(q, d)
        elif q.children and (not d.children or q.radius > d.radius):
            for child in q.children:
                visit(child, d, bound(child, d))
        else:
            pairs = sorted(((bound(q, child), k) for k, child in enumerate(d.children)), reverse=True)
            for value, k in pairs:
                visit(q, d.children[k], value)

    descend(queries, tree)
    visit(queries, tree, bound(queries, tree))


def _whole(matrix: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x); beyond the range of a long the nearest long."""
    with np.errstate(over="ignore"):
        return np.floor(matrix * scale)


def _exact(points: np.ndarray, data: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Plain integers for numbers too large for exact doubles; scores stop at the range of a long."""
    whole = lambda m: [[max(-_MOST, min(_MOST, int(max(-1e300, min(1e300, x))))) for x in row] for row in m]
    rows, found = whole(data), []
    for q, point in enumerate(whole(points)):
        scores = [max(-_MOST, min(_MOST, sum(a * b for a, b in zip(point, row)))) for row in rows]
        scored = sorted((-s, int(i)) for s, i in zip(scores, ids) if i != own[q])
        found += [(q, i, -s) for s, i in scored[:k]]
    return found


def _search_blocks(queries: Broadcast, k: int, scale: float, block: int):
    """The best ``k`` of a task's rows for every query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = {}
        for n, (ids, matrix) in queries.value.items():
            points = _whole(matrix, scale)
            groups[n] = ids, points, cover_tree(points, QUERY_LEAF), TopK(len(ids), k), float(np.abs(points).max(initial=0))
        exact = []
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                all_ids = part.column("id").to_numpy()
                for n, (rows, matrix) in by_length(part.column("vector")).items():
                    if n not in groups:
                        continue
                    own, points, tree, best, largest = groups[n]
                    data, ids = _whole(matrix, scale), all_ids[rows]
                    if largest * float(np.abs(data).max(initial=0)) * max(n, 1) < 2**53:
                        search(cover_tree(data), data, ids, tree, points, own, best)
                    else:
                        found = _exact(points, data, own, ids, k)
                        exact += [(int(own[q]), i, s) for q, i, s in found]
        out = [
            (np.repeat(own, k)[some], best.ids.reshape(-1)[some], best.scores.reshape(-1)[some].astype(np.int64))
            for own, _, _, best, _ in groups.values()
            for some in [np.isfinite(best.scores.reshape(-1))]
        ]
        if exact:
            out.append(tuple(np.array(c, np.int64) for c in zip(*exact)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "id", "score"])

    return run


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    vector: str = "embedding",
    id: str = "vec_id",
    scale: float = 1024.0,
    query_bytes: int = QUERY_BYTES,
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` rows with the highest inner product for every query among the rows.

    Components are floor(``scale`` * x); scores are exact integers; ties go to
    the smaller id; rows with the query's own id are no candidates. The queries
    are taken in blocks of ``query_bytes``; a block is broadcast and every task
    searches its rows for it, so no row of data is moved: only k rows per query
    and task are. Vectors that are null or hold null or non-finite components,
    and rows without an id, take no part. Vectors meet only vectors of their
    length. A repeated candidate row counts as often as it is there; an id that
    stands for several query vectors asks once, with the smallest (component by
    component). Components and scores outside the range of a long become its
    ends before they are ranked.

    Result: ``query_id``, ``rank`` (from 1), ``id``, ``score``.
    """
    require_columns(rows, vector, id)
    if id in ("query_id", "rank", "score"):
        raise ValueError(f"the id column cannot be named {id}")
    spark = rows.sparkSession
    marked = rows.withColumn("__query", is_query).where(usable(vector) & F.col(f"`{id}`").isNotNull())
    data = marked.select(
        F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), "__query"
    )
    queries = data.where("__query").groupBy("id").agg(F.min("vector").alias("vector"))
    size = queries.agg(F.sum(F.size("vector") * 8 + 16)).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    parts = []
    for b in range(blocks):
        held = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        ids = held.column("id").to_numpy()
        groups = {n: (ids[at], m) for n, (at, m) in by_length(held.column("vector")).items()} if len(ids) else {}
        shared = spark.sparkContext.broadcast(groups)
        parts.append(
            data.select("id", "vector").mapInArrow(_search_blocks(shared, k, scale, block), "query_id LONG, id LONG, score LONG")
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id), "score")
    )
