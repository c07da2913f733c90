from __future__ import annotations

import numpy as np
import pytest

from stridemill.llm import pivots, queries


def brute(matrix, ids, least=0.95):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    links, root = {}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = set()
    for k in range(len(ids)):
        near = np.flatnonzero(unit @ unit[k] >= least)
        links[ids[k]] = len(near) - 1
        for j in near[near > k].tolist():
            pairs.add((ids[k], ids[j]))
            a, b = find(ids[k]), find(ids[j])
            root[max(a, b)] = min(a, b)
    return links, {i: find(i) for i in ids}, pairs


def clusters(rng, n, d=24):
    centers = rng.normal(size=(n // 10, d))
    out = np.concatenate([centers, centers[rng.integers(0, len(centers), n - len(centers))] + rng.normal(size=(n - len(centers), d)) * 0.12])
    return out[rng.permutation(n)]


@pytest.mark.parametrize("block", [2048, 16])
def test_links_and_components(spark, block):
    rng = np.random.default_rng(3)
    matrix = clusters(rng, 600)
    matrix[500:520] = matrix[7]
    ids = list(range(100, 700))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, matrix)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    links, component, pairs = brute(matrix, ids)
    got = pivots.linked_vectors(frame, block=block).collect()
    found = sum(r.n_links for r in got)
    assert 0.9 * 2 * len(pairs) <= found <= 2 * len(pairs)
    assert all(r.n_links <= links[r.vec_id] for r in got)
    assert np.mean([r.component_id == component[r.vec_id] for r in got]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_blocks_give_the_same_links(spark):
    rng = np.random.default_rng(9)
    matrix = clusters(rng, 300)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    whole, cut = (sorted(map(tuple, pivots.linked_vectors(frame, block=b).collect())) for b in (2048, 5))
    assert whole == cut


def test_edges(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]),
        (8, [None, 1.0]), (9, [float("inf"), 1.0]), (10, [1e200, 1e-200]), (11, [1.0]), (12, [1.0, 0.0]), (12, [1.0, 0.0]),
        (None, [-2.0, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id LONG, embedding ARRAY<DOUBLE>, copies INT, pivot STRING")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in pivots.linked_vectors(frame).collect())
    assert got == sorted(
        [(1, 3, 1, True), (2, 3, 1, False), (10, 3, 1, False), (12, 3, 1, False), (12, 3, 1, False), (3, 1, 0, False), (0, 1, 0, True)]
        + [(k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 11)]
    )
    assert pivots.linked_vectors(frame.limit(0)).count() == 0
    alone = frame.where("vec_id = 4")
    assert [tuple(r) for r in pivots.linked_vectors(alone).collect()] == [(4, 0, 4, True)]


def planted(matrix, cosine=0.951, share=10, seed=4):
    """The given vectors, and beside one in ``share`` of them another at ``cosine``."""
    rng = np.random.default_rng(seed)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    some = unit[::share]
    away = rng.normal(size=some.shape)
    away -= (away * some).sum(1, keepdims=True) * some
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    return np.concatenate([matrix, cosine * some + np.sqrt(1 - cosine**2) * away])


def found_share(spark, matrix):
    """Found of all links; none may be wrong."""
    links = counted(matrix)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    got = {r.vec_id: r.n_links for r in pivots.linked_vectors(frame).collect()}
    found = np.array([got[i] for i in range(len(matrix))])
    assert links.sum() > 0 and (found <= links).all()
    return found.sum() / links.sum()


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_pairs_planted_beside_the_given_vectors(spark, scale):
    rows = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").select("embedding").collect()
    assert found_share(spark, planted(np.array([r.embedding for r in rows], float))) >= 0.98


@pytest.mark.parametrize("mean, n", [(0.7, 3000), (0.85, 3000), (0.9, 1000), (0.9, 4000)])
def test_vectors_that_all_point_one_way(spark, mean, n):
    rng = np.random.default_rng(int(mean * 100))
    assert found_share(spark, planted(around(rng, rng.normal(size=64), n, mean))) >= 0.95


@pytest.mark.parametrize("mean", [0.0, 0.85, 0.9])
def test_pivots_are_enough_whatever_way_vectors_point(mean):
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(2000, 64)) if not mean else around(rng, rng.normal(size=64), 2000, mean)
    _, points = pivots.choose_pivots(pivots._unit(matrix), 89, 0.95)
    assert 64 <= len(points) <= 89


def test_copies_of_a_vector_stay_few(spark):
    """Long lists are parted by the second pivot: a vector is sent to no more lists than it has pairs of pivots."""
    rng = np.random.default_rng(2)
    matrix = around(rng, rng.normal(size=32), 3000, 0.85)
    unit = pivots._unit(matrix)
    center, points = pivots.choose_pivots(unit, 100, 0.95)
    order = pivots.nearest_pivots(pivots._unit(unit - center), points, 12)
    frame = spark.createDataFrame(
        [(i, 1, 32, o.tolist(), b"") for i, o in enumerate(order)], "id LONG, copies LONG, size INT, order ARRAY<INT>, vector BINARY"
    )
    met = [pivots._meetings(frame, shared, 50).select("id", "pivot", "second").toPandas() for shared in (2, 1)]
    copies = [m.groupby("id").size().max() for m in met]
    pairs = [(m.drop_duplicates().groupby(["pivot", "second"]).size() ** 2).sum() for m in met]
    assert copies[0] <= 12 * 11 and pairs[0] < 0.8 * pairs[1]


def test_parted_lists_give_the_same_links(spark):
    rng = np.random.default_rng(19)
    matrix = clusters(rng, 400)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    whole, cut = (sorted(map(tuple, pivots.linked_vectors(frame, block=b).collect())) for b in (2048, 20))
    assert whole == cut


def test_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    matrix = np.array([r.embedding for r in rows], float)
    links, component, pairs = brute(matrix, [r.vec_id for r in rows])
    got = queries.QUERIES["op7_embedding_dedup"](spark, folder).collect()
    assert len(got) == len(rows) and not pairs  # links are planted beside them above
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got)


def counted(matrix, least=0.95):
    """Links of each vector by brute force."""
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.concatenate([(unit[k : k + 1000] @ unit.T >= least).sum(1) for k in range(0, len(unit), 1000)]) - 1


def around(rng, center, n, cosine):
    """Vectors at about ``cosine`` to each other."""
    noise = rng.normal(size=(n, len(center))) / len(center) ** 0.5
    return center + noise * np.linalg.norm(center) * (1 / cosine - 1) ** 0.5


def hot_third(n, cosine, d=64, seed=5):
    rng = np.random.default_rng(seed)
    matrix = rng.normal(size=(n, d))
    matrix[: n // 3] = around(rng, rng.normal(size=d), n // 3, cosine)
    return matrix[rng.permutation(n)]


@pytest.mark.parametrize("n", [1500, 6000])
def test_hot_group_keeps_its_links(spark, n):
    matrix = hot_third(n, 0.98)
    links = counted(matrix)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    got = {r.vec_id: r for r in pivots.linked_vectors(frame).collect()}
    found = np.array([got[i].n_links for i in range(n)])
    assert links.sum() > (n // 3) ** 2 // 2 and (found <= links).all()
    assert found.sum() >= 0.99 * links.sum()
    assert len({got[i].component_id for i in np.flatnonzero(links).tolist()}) == 1
