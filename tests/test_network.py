"""The classifier against plain numpy, finite differences and other partitionings."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridemill.operators import network


@pytest.fixture(scope="module")
def problem(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + 2 * (x[:, 2] > 0.3)
    rows = [(int(i), v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "pos INT, x ARRAY<DOUBLE>, y INT"), x, y


def mean_loss(layers, x, y):
    return network.loss_and_gradient(layers, x, y)[0] / len(y)


def test_gradient_is_the_slope_of_the_loss(problem):
    _, x, y = problem
    layers = network.start([5, 7, 6, 4], 3)
    flat = network._flat(layers)
    slope = network.loss_and_gradient(layers, x, y)[1:] / len(y)
    for k in range(0, len(flat), 5):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        high, low = (mean_loss(network._shaped(flat + s * step, layers), x, y) for s in (1, -1))
        assert np.isclose((high - low) / 2e-6, slope[k], atol=1e-6)


def test_steps_equal_numpy(problem):
    df, x, y = problem
    layers = network.start([5, 6, 6, 4], 1)
    point, speed = network._flat(layers), 0.0
    for _ in range(4):
        ahead = network._shaped(point + 0.9 * speed, layers)
        speed = 0.9 * speed - 0.1 * network.loss_and_gradient(ahead, x, y)[1:] / len(y)
        point = point + speed
    model = network.train(df, "x", "y", layers, 4, "nesterov", 0.1, 0.9)
    assert np.allclose(network._flat(model.layers), point, atol=1e-10)


def test_the_same_rows_give_the_same_model_in_any_order(problem):
    df, *_ = problem
    models = [
        network._flat(network.train(d, "x", "y", network.start([5, 4, 4, 4]), 6).layers)
        for d in (df, df.orderBy(F.desc("pos")), df.repartition(7))
    ]
    assert np.allclose(models[0], models[1], atol=1e-6) and np.allclose(models[0], models[2], atol=1e-6)
    again = network._flat(network.train(df, "x", "y", network.start([5, 4, 4, 4]), 6).layers)
    assert np.array_equal(models[0], again)


def test_quasi_newton_learns_what_no_line_can(problem):
    df, x, y = problem
    model = network.fit_classifier(df, "x", "y", hidden=12, classes=4, seed=2, max_iter=60)
    assert mean_loss(model.layers, x, y) < 0.25  # a line stays above 0.9
    scored = network.classify(model, df, "x")
    assert scored.columns == ["pos", "x", "y", "prediction"]
    assert scored.where("prediction = y").count() >= 216


def test_units_are_rectified(problem):
    """With two hidden units of opposite sign the scores are the two halves of the input."""
    df, x, _ = problem
    layers = [(np.array([[1.0, -1.0]] + [[0.0, 0.0]] * 4), np.zeros(2)), (np.eye(2), np.zeros(2)), (np.eye(2), np.zeros(2))]
    got = network.classify(network.Classifier(layers), df, "x").orderBy("pos").collect()
    assert [r["prediction"] for r in got] == [int(v[0] < 0) for v in x]


def test_nulls_and_wrong_rows(spark, problem):
    df, x, y = problem
    more = df.unionByName(spark.createDataFrame([(900, None, 1), (901, [1.0] * 5, None)], df.schema))
    layers = network.start([5, 4, 4, 4])
    a, b = (network._flat(network.train(d, "x", "y", layers, 2, "nesterov").layers) for d in (df, more))
    assert np.allclose(a, b, atol=1e-11)
    for bad in ([(1, [1.0] * 5, 4)], [(1, [1.0] * 5, -1)], [(1, [1.0] * 3, 1)]):
        with pytest.raises(Exception, match="labels must be|vectors must have"):
            network.train(spark.createDataFrame(bad, df.schema), "x", "y", layers, 1)
    with pytest.raises(ValueError):
        network.train(df.limit(0), "x", "y", layers, 1)
    with pytest.raises(ValueError):
        network.train(df, "x", "y", layers, 1, "adam")
