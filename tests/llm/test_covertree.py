from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridemill.llm import covertree, queries


def brute(rows, k, every=100, scale=1024.0):
    good = [
        (i, [math.floor(scale * float(x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = {}
    for q, point in {(i, tuple(v)) for i, v in good if i % every == 0}:
        ends = lambda s: max(1 - 2**63, min(2**63 - 1, s))
        scored = sorted((-ends(sum(a * b for a, b in zip(point, v))), i) for i, v in good if i != q and len(v) == len(point))
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def collected(frame, id="vec_id"):
    out = {}
    for r in frame.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r[id], r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_cover_tree_invariants():
    rng = np.random.default_rng(0)
    points = np.r_[rng.normal(size=(400, 6)), np.repeat(rng.normal(size=(1, 6)), 90, 0)]

    def walk(node):
        d = np.sqrt(((points[node.rows] - node.center) ** 2).sum(1))
        assert d.max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            assert (node.children[0].center == node.center).all()
            centers = np.stack([c.center for c in node.children])
            apart = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2)) + np.eye(len(centers)) * 1e9
            assert apart.min() >= max(c.radius for c in node.children) - 1e-9
            for c in node.children:
                walk(c)

    walk(covertree.cover_tree(points, 8))


def test_pruning_leaves_pairs_out(monkeypatch):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 3)) * 1000
    data = np.floor(np.repeat(centers, 60, 0) + rng.normal(size=(1800, 3)))
    points = data[::50].copy()
    best = covertree.TopK(len(points), 5)
    merged = []
    real = covertree.TopK.merge
    monkeypatch.setattr(covertree.TopK, "merge", lambda s, r, sc, i: (merged.append(sc.size), real(s, r, sc, i)))
    own = np.arange(0, 1800, 50)
    covertree.search(covertree.cover_tree(data, 32), data, np.arange(1800), covertree.cover_tree(points, 8), points, own, best)
    assert sum(merged) < 0.5 * len(points) * len(data)
    scores = points @ data.T
    scores[np.arange(len(points)), own] = -np.inf
    assert (np.sort(scores, 1)[:, ::-1][:, :5] == best.scores).all()


@pytest.mark.parametrize("limits", [{}, {"query_bytes": 300, "block": 7}])
def test_against_brute_force(spark, limits):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3) / 4]) for i in range(300)]
    rows += [(300, [0.1, 0.2, 0.3])] * 2 + [(301, [1e30, 1.0, 2.0]), (400, [1e18, -1e18, 5.0])]
    rows += [(500, None), (600, [1.0, None, 2.0]), (700, [float("nan"), 1.0, 1.0]), (800, [float("inf"), 0.0, 1.0])]
    rows += [(900, []), (901, []), (1000, [1.0, 2.0]), (1001, [3.0, 4.0]), (1100, [0.0] * 3), (None, [1.0, 1.0, 1.0]), (1200, [5.0])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id LONG, embedding ARRAY<DOUBLE>, rank INT, score INT")
    got = collected(covertree.top_k(frame, F.col("vec_id") % 100 == 0, 10, **limits))
    most = 2**63 - 1
    cut = [(i, v and [x if x is None or not math.isfinite(x) else max(-most, min(most, math.floor(x * 1024))) for x in v]) for i, v in rows]
    want = brute(cut, 10, scale=1)
    assert got == {q: v for q, v in want.items() if v}


def test_empty(spark):
    empty = spark.createDataFrame([], "vec_id LONG, embedding ARRAY<FLOAT>")
    assert covertree.top_k(empty, F.col("vec_id") % 100 == 0).count() == 0


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert collected(queries.QUERIES["op3_exact_top_k"](spark, data)) == brute(rows, 10)
