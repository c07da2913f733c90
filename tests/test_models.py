"""Dense scoring, weight tables, projections and classifiers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridemill.operators import projection, scoring


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(7)
    return rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6)) + rng.normal(size=6)


@pytest.fixture(scope="module")
def rows(spark, matrix):
    return spark.createDataFrame(
        [(i, [float(v) for v in r], int(r[0] > r[1])) for i, r in enumerate(matrix)], "pos INT, x ARRAY<DOUBLE>, y INT"
    ).repartition(3)


def collected(df, column):
    return np.array([r[column] for r in df.orderBy("pos").collect()])


def layers(widths, seed=0):
    rng = np.random.default_rng(seed)
    return [(rng.normal(size=(a, b)), rng.normal(size=b)) for a, b in zip(widths, widths[1:])]


def test_dense_stack(rows, matrix):
    net = layers([6, 5, 4, 2])
    want = matrix
    for i, (w, b) in enumerate(net):
        want = want @ w + b
        want = np.maximum(want, 0) if i < 2 else want
    out = rows.withColumn("s", scoring.dense(net, "x", batch_size=7))
    assert np.allclose(collected(out, "s"), want)


def test_autoencoder_halves(rows, matrix):
    assert scoring.autoencoder_widths(64, 4) == [64, 32, 16, 4, 16, 32, 64]
    net = layers([6, 3, 1, 2, 1, 3, 6], 1)
    z = scoring.forward(net[:3], [True, True, False], matrix)
    back = scoring.forward(net[3:], [True, True, False], z)
    out = rows.withColumn("z", scoring.encode(net, "x")).withColumn("b", scoring.autoencode(net, "x"))
    assert np.allclose(collected(out, "z"), z) and np.allclose(collected(out, "b"), back)


def test_layers_must_fit():
    with pytest.raises(ValueError):
        scoring.check_layers([])
    with pytest.raises(ValueError):
        scoring.check_layers([(np.zeros((2, 3)), np.zeros(2))])
    with pytest.raises(ValueError):
        scoring.check_layers(layers([2, 3]) + layers([4, 1]))


def test_weight_table(spark, tmp_path, monkeypatch):
    net, path = layers([3, 2, 1]), str(tmp_path / "w")
    scoring.write_weights(spark, net, path)
    back = scoring.load_weights(spark.read.parquet(path))
    assert all(np.array_equal(a, b) for x, y in zip(net, back) for a, b in zip(x, y))
    monkeypatch.setattr(scoring, "MAX_WEIGHTS", 5)
    with pytest.raises(ValueError, match="weights, more than"):
        scoring.load_weights(spark.read.parquet(path))


def test_user_model_and_report(rows, matrix):
    out = scoring.score_rows(rows, lambda: lambda x: x[:, :2], "x", 6)
    assert np.allclose(collected(out, "prediction"), matrix[:, :2])
    report = scoring.score_report(out, ["accuracy"], target="y").first()["accuracy"]
    assert np.isclose(report, 100 * np.mean(matrix[:, :2].argmax(1) == (matrix[:, 0] > matrix[:, 1])))
    classes = scoring.predictions(out, "prediction", "y", keep=["pos"])
    assert np.array_equal(collected(classes, "prediction"), matrix[:, :2].argmax(1))


def test_batches_are_consumed_in_the_tasks(spark, tmp_path):
    def write(batch):
        first = batch["id"].iloc[0]
        (tmp_path / f"{first:04d}").write_text(" ".join(map(str, batch["id"])))

    df = spark.range(0, 100, 1, 2)
    assert scoring.for_each_batch(df, write, 16) == 100
    sizes = [len(p.read_text().split()) for p in sorted(tmp_path.iterdir())]
    assert sizes == [16, 16, 16, 2] * 2
    assert scoring.for_each_batch(df.where("id < 0"), write, 16) == 0
    with pytest.raises(ValueError):
        scoring.for_each_batch(df, write, 0)


def test_latent_sample(spark):
    df = spark.createDataFrame([(i, [1.0, -2.0], [0.0, 2.0]) for i in range(3000)], "pos INT, m ARRAY<DOUBLE>, v ARRAY<DOUBLE>")
    quiet = df.select("pos", scoring.latent_sample("m", "v", ["pos"], training=False).alias("z"))
    assert quiet.where("z[0] != 1 OR z[1] != -2").count() == 0
    noisy = df.select("pos", scoring.latent_sample("m", "v", ["pos"]).alias("z"))
    z = collected(noisy, "z")
    assert np.allclose(z.mean(0), [1, -2], atol=0.15) and np.allclose(z.std(0), [1, np.e], rtol=0.1)
    assert abs(np.corrcoef(z.T)[0, 1]) < 0.1
    assert np.array_equal(z, collected(noisy.repartition(5), "z"))


def test_pca(rows, matrix):
    model = projection.fit_pca(rows, "x", 3)
    centred = matrix - matrix.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    z = collected(model.transform(rows, "x"), "z")
    assert np.allclose(np.abs(z), np.abs(centred @ vt[:3].T))
    assert np.allclose(model.explained, (s**2 / (s**2).sum())[:3])
    back = collected(model.reconstruct(rows, "x"), "reconstruction")
    assert np.allclose(back, centred @ vt[:3].T @ vt[:3] + matrix.mean(0))
    full = projection.fit_pca(rows, "x", 6)
    assert np.allclose(collected(full.reconstruct(rows, "x"), "reconstruction"), matrix)


def test_svd(rows, matrix):
    model = projection.fit_svd(rows, "x", 3)
    _, s, vt = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(model.singular_values, s[:3])
    z = collected(rows.withColumn("z", model.transform("x")), "z")
    assert np.allclose(np.abs(z), np.abs(matrix @ vt[:3].T))


def test_covariance(rows, matrix):
    out = {(r["i"], r["j"]): r["value"] for r in projection.covariance(rows, "x").collect()}
    want = np.cov(matrix.T)
    assert len(out) == 21
    assert all(np.isclose(v, want[k]) for k, v in out.items())


def test_classifiers(rows):
    model = projection.fit_classifier(rows, "x", "y", hidden=6, classes=2, max_iter=100)
    scored = projection.classify(model, rows, "x")
    assert scored.columns == ["pos", "x", "y", "prediction"]
    assert scored.where("prediction = y").count() >= 50
    both = projection.CompressedClassifier.fit(rows, "x", "y", latents=4, hidden=5, classes=2)
    out = both.transform(rows, "x")
    assert out.columns == ["pos", "x", "y", "prediction"] and out.count() == 60
    assert out.agg(F.countDistinct("prediction")).first()[0] == 2


@pytest.mark.parametrize("k", [1, 5, 6])
def test_singular_vectors_have_a_fixed_sign(rows, matrix, k):
    values, vectors = projection.right_singular(rows, "x", k)
    _, s, vt = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(values, s[:k])
    assert np.allclose(np.abs(vectors), np.abs(vt[:k].T))
    assert (vectors[np.abs(vectors).argmax(0), np.arange(k)] > 0).all()


def test_wide_vectors(spark, monkeypatch):
    """20,000 components: neither a square of them nor the rows come to the driver."""
    rng = np.random.default_rng(12)
    shape = rng.normal(size=(50, 24)) * 0.7 ** np.arange(24)
    matrix = shape @ rng.normal(size=(24, 20_000)) + rng.normal(size=(50, 20_000)) * 1e-4
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(matrix)], "pos INT, x ARRAY<DOUBLE>").repartition(4)
    largest = []
    real = projection.added
    monkeypatch.setattr(projection, "added", lambda states: largest.append((v := real(states)).size) or v)
    model = projection.fit_svd(df, "x", 16)
    _, s, vt = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(model.singular_values, s[:16], rtol=1e-6)
    assert np.allclose(np.abs((model.components * vt[:16].T).sum(0)), 1, atol=1e-5)
    assert largest and max(largest) <= 20_000 * 32
    centred = matrix - matrix.mean(0)
    pca = projection.fit_pca(df, "x", 8)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(pca.explained, (s**2 / (s**2).sum())[:8], rtol=1e-6)
    z = collected(pca.transform(df, "x"), "z")
    assert np.allclose(np.abs(z), np.abs(centred @ vt[:8].T), rtol=1e-3, atol=1e-3)


def test_directions_agree_with_all_directions(spark, monkeypatch):
    """At 64 components the few directions find what all directions find."""
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(300, 64)) * 0.8 ** np.arange(64)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(matrix)], "pos INT, x ARRAY<DOUBLE>")
    exact = projection.fit_svd(df, "x", 6)
    monkeypatch.setattr(projection, "WHOLE_WIDTH", 8)
    few = projection.fit_svd(df, "x", 6)
    assert np.allclose(few.singular_values, exact.singular_values, rtol=1e-9)
    assert np.allclose(few.components, exact.components, atol=1e-5)


def test_fewer_rows_than_directions_and_bad_input(spark):
    df = spark.createDataFrame([(0, [3.0, 0.0, 4.0]), (1, None)], "pos INT, x ARRAY<DOUBLE>")
    model = projection.fit_svd(df, "x", 3)
    assert np.allclose(model.singular_values, [5, 0, 0]) and np.allclose(np.abs(model.components[:, 0]), [0.6, 0, 0.8])
    assert np.allclose(model.components.T @ model.components, np.eye(3))
    for bad in (0, 4):
        with pytest.raises(ValueError):
            projection.fit_svd(df, "x", bad)
    with pytest.raises(ValueError):
        projection.fit_svd(df.where("x IS NULL"), "x", 1)
