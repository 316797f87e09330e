"""Squared hinge support vectors: optimality, an independent search, odd rows."""

import numpy as np
import pytest

from inkprint.operators.support_vectors import is_optimal, support_vector_labels, train_support_vectors

SCHEMA = "id long, values array<double>, label int"


def rows_of(spark, x, labels):
    return spark.createDataFrame([(i, v, k) for i, (v, k) in enumerate(zip(x.tolist(), labels.tolist()))], SCHEMA)


def gradient(w, x, y, c):
    x = np.hstack([x, np.ones((len(x), 1))])
    gaps = np.maximum(0, 1 - y * (x @ w))
    return w - 2 * c * ((gaps * y) @ x)


def descent(x, y, c):
    """The optimum by steps along the gradient alone."""
    wide = np.hstack([x, np.ones((len(x), 1))])
    size = 1 / (1 + 2 * c * np.linalg.eigvalsh(wide.T @ wide)[-1])
    w = np.zeros(wide.shape[1])
    for _ in range(200_000):
        step = gradient(w, x, y, c)
        w = w - size * step
        if np.linalg.norm(step) < 1e-10:
            break
    return w


@pytest.mark.parametrize("c", [0.1, 10.0])
def test_the_optimum(spark, c):
    draw = np.random.default_rng(1)
    x, labels = draw.standard_normal((150, 3)), draw.integers(0, 3, 150) * 2
    x += labels[:, None] * 0.3
    model = train_support_vectors(rows_of(spark, x, labels), c=c)
    assert model.classes == [0, 2, 4] and is_optimal(model, 1e-4)
    for k, w in zip(model.classes, model.weights):
        y = np.where(labels == k, 1, -1)
        assert np.linalg.norm(gradient(np.array(w), x, y, c)) < 1e-4
        assert np.allclose(w, descent(x, y, c), atol=1e-5)


def test_labels_and_odd_rows(spark):
    rows = [(i, [float(i % 3 == 0), float(i % 3 == 1)], i % 3) for i in range(30)]
    odd = [(50, None, 1), (51, [1.0, 0.0], None), (52, [1.0], 0), (None, [1.0, 0.0], 0)]
    train = spark.createDataFrame(rows + odd, SCHEMA)
    model = train_support_vectors(train)
    assert [len(w) for w in model.weights] == [3, 3, 3]
    labels = support_vector_labels(train.filter("id < 50"), model, "id").collect()
    assert all(r["label"] == r["id"] % 3 for r in labels) and len(labels) == 30
    none = train_support_vectors(train.filter("false"))
    assert none.classes == [] and is_optimal(none, 0.0)
    single = train_support_vectors(train.filter("label = 1 AND id < 50"))
    assert single.classes == [1]
