"""Clusters against rounds worked out in Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from stridemill.llm import centroids, queries


def _clusters(rows, width=64, k=40, rounds=5, scale=256):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [q for _, q in order[:k]]

    def assign():
        out = []
        for i, q in kept:
            d = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in cs]
            best = min(range(len(cs)), key=lambda j: (d[j], j))
            out.append((i, q, best, d[best]))
        return out

    for _ in range(rounds):
        groups = {}
        for _, q, c, _ in assign():
            groups.setdefault(c, []).append(q)
        for c, members in groups.items():
            cs[c] = [sum(col) // len(members) for col in zip(*members)]
    last = assign()
    total = sum(r[3] for r in last)
    own = {}
    for _, _, c, d in last:
        own[c] = own.get(c, 0) + d
    return sorted(((i, c, d, own[c], total, cs[c]) for i, _, c, d in last), key=repr)


def _found(frame, id="vec_id"):
    cols = ["cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    return sorted(((r[id], *(r[c] for c in cols)) for r in frame.collect()), key=repr)


def _frame(spark, rows, kind="DOUBLE"):
    return spark.createDataFrame(rows, f"vec_id LONG, embedding ARRAY<{kind}>")


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = {r["vec_id"]: r for r in queries.QUERIES["op13_centroid_clusters"](spark, data).collect()}
    expected = _clusters(rows)
    assert len(out) == len(expected)
    for i, c, d, own, total, centre in expected:
        r = out[i]
        assert (r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"]) == (c, d, own, total)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()


def test_clustered_vectors_in_small_blocks(spark):
    rng = random.Random(2)
    centres = [[rng.uniform(-40, 40) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 1) for x in rng.choice(centres)]) for i in range(600)]
    rows += [(1000 + i, centres[0]) for i in range(200)]  # one vector a quarter of the rows
    expected = _clusters(rows, 8, 9, 4)
    for size in (1, 16, 256):
        out = centroids.cluster_vectors(_frame(spark, rows), width=8, clusters=9, rounds=4, block_rows=size)
        assert _found(out) == expected


def test_nulls_odd_vectors_ties_and_repeats(spark):
    rows = [
        (None, [1.0, 2.0]), (None, [5.0, 5.0]), (1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 0.0]), (7, [0.0, 0.0]), (7, [0.0, 0.0]), (7, [2.0, 0.0]), (8, [-1.0, 0.001]), (9, [1.0, 0.0]),
    ]
    for k in (1, 2, 3, 40):
        out = centroids.cluster_vectors(_frame(spark, rows), width=2, clusters=k, rounds=3)
        assert _found(out) == _clusters(rows, 2, k, 3)
    assert _found(centroids.cluster_vectors(_frame(spark, rows[2:8]), width=2)) == []
    assert _found(centroids.cluster_vectors(_frame(spark, rows).limit(0), width=2)) == []


def test_large_integers_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-500_000, 500_000) for _ in range(4)]) for i in range(60)] + [(99, [1e300, 0.0, 0.0, 0.0])]
    out = centroids.cluster_vectors(_frame(spark, rows), width=4, clusters=7)
    assert _found(out) == _clusters(rows[:-1], 4, 7)


def test_floats_and_clashing_columns(spark):
    rows = [(i, [i / 7, (i * i % 11) / 3]) for i in range(30)]
    df = _frame(spark, rows, "FLOAT").selectExpr("vec_id AS id", "embedding AS q", "1 AS place", "2 AS data")
    own = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert _found(centroids.cluster_vectors(df, "q", "id", width=2, clusters=4), "id") == _clusters(own, 2, 4)
    with pytest.raises(ValueError):
        centroids.cluster_vectors(df.withColumnRenamed("id", "cluster"), "q", "cluster", width=2)


def test_hilbert_neighbours_differ_by_one_step():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * n), -1).reshape(-1, n)
        keys = centroids.hilbert_keys(cells, bits)
        order = sorted(range(len(cells)), key=lambda i: keys[i].tobytes())
        assert len({k.tobytes() for k in keys}) == len(cells)
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_candidates_hold_the_nearest_and_leave_out_far_ones():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.integers(-50, 50, 6) + rng.integers(-3, 4, (40, 6))
        c = rng.integers(-60, 60, (30, 6))
        near = centroids.candidates(x.min(0), x.max(0), c)
        d = centroids.distances(x, c)
        assert set(d.argmin(1)) <= set(near)
        assert len(near) < 30
