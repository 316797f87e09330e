"""Linear support vectors with squared hinge loss, one class against the rest.

For each class the weights w minimise ``|w|^2 / 2 + C * sum(max(0, 1 - y w.x)^2)`` over all rows, y
being 1 for the class and -1 for others, and x the values with a 1 behind them, so that the offset is
one more weight. The function is strictly convex: there is one optimum, whatever way leads there.

It is found by Newton steps whose equations are solved by conjugate gradients. Gradients,
objectives and products with the Hessian are sums over rows, which one aggregate returns as one
row for all classes at once; only the weights, a number for each class and value, are on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.operators.classify import linear_labels
from inkprint.session import materialize

MAX_STEPS = 40
MAX_PRODUCTS = 60
#: The norm of the gradient against that at weights of zero.
TOLERANCE = 1e-9


@dataclass(frozen=True)
class LinearModel:
    """``weights`` has a line for each of ``classes``; the last weight of a line is the offset.

    ``gradient`` is the norm of each class's gradient where the search ended.
    """

    classes: list[int]
    weights: list[list[float]]
    gradient: list[float]


Sums = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _added_up(work: Sums):
    """Sum ``work(x, y)`` over the batches of a partition; one row for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
                y = batch["y"].flatten().to_numpy().reshape(batch.num_rows, -1)
                part = work(x, y)
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])

    return run


class _Problem:
    """Sums over the rows of (x, y): x ends with the constant, y has 1 or -1 for each class.

    Products of batches with the weights are matrix products, in Arrow batches: arrays of
    Spark's own functions were ten times slower.
    """

    def __init__(self, rows: DataFrame, classes: int, width: int, c: float):
        self.rows, self.shape, self.c = rows, (classes, width), c

    def _summed(self, work: Sums, length: int) -> np.ndarray:
        parts = self.rows.mapInArrow(_added_up(work), "part array<double>")
        total = parts.agg(Summarizer.sum(array_to_vector("part")).alias("total")).first()["total"]
        return np.zeros(length) if total is None or total.size == 0 else total.toArray()

    def at(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Objective and gradient of each class."""
        k, d = self.shape

        def work(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            # What a row lacks to the margin; nothing beyond it.
            gaps = np.maximum(1 - y * (x @ weights.T), 0)
            return np.concatenate([(gaps**2).sum(axis=0), ((gaps * y).T @ x).ravel()])

        total = self._summed(work, k + k * d)
        objective = (weights**2).sum(axis=1) / 2 + self.c * total[:k]
        return objective, weights - 2 * self.c * total[k:].reshape(k, d)

    def product(self, weights: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The Hessian of each class at ``weights``, times ``by``: rows short of the margin count."""

        def work(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            short = y * (x @ weights.T) < 1
            return ((short * (x @ by.T)).T @ x).ravel()

        return by + 2 * self.c * self._summed(work, by.size).reshape(self.shape)

    def newton_step(self, weights: np.ndarray, gradient: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Conjugate gradients for all classes side by side, until each one's rest is small enough."""
        # The closer to the optimum, the more exact the step has to be.
        wanted = np.minimum(0.1, np.sqrt(norm)) * norm
        step, rest = np.zeros(self.shape), -gradient
        way, left = rest.copy(), (rest**2).sum(axis=1)
        for _ in range(MAX_PRODUCTS):
            open_ = np.sqrt(left) > wanted
            if not open_.any():
                break
            curved = self.product(weights, way)
            size = np.where(open_, left / np.maximum((way * curved).sum(axis=1), 1e-300), 0.0)
            step += size[:, None] * way
            rest = rest - size[:, None] * curved
            now = (rest**2).sum(axis=1)
            way = np.where(open_[:, None], rest + (now / np.maximum(left, 1e-300))[:, None] * way, 0.0)
            left = np.where(open_, now, left)
        return step


def train_support_vectors(
    train: DataFrame, values: str = "values", label: str = "label", c: float = 1.0, tolerance: float = TOLERANCE
) -> LinearModel:
    """Fit the weights of every label that ``train`` holds.

    Rows without a label, without values, or with another number of values than the widest row
    take no part; a null value counts as 0. Rows may repeat, and count as often. The labels are
    the classes of a task, few; the rows are written once and read by each pass. Without a row there is
    no class.
    """
    known = train.select(
        F.transform(F.col(values).cast("array<double>"), lambda v: F.coalesce(v, F.lit(0.0))).alias("x"),
        F.col(label).cast("int").alias("label"),
    ).filter(F.col("x").isNotNull() & F.col("label").isNotNull())
    found = known.groupBy("label").agg(F.max(F.size("x")).alias("width")).collect()
    classes = sorted(r["label"] for r in found)
    if not classes:
        return LinearModel([], [], [])
    width = max(r["width"] for r in found)
    sides = F.transform(F.lit(classes), lambda k: F.when(F.col("label") == k, 1.0).otherwise(-1.0))
    rows = materialize(
        known.filter(F.size("x") == width).select(F.concat("x", F.array(F.lit(1.0))).alias("x"), sides.alias("y"))
    )
    problem = _Problem(rows, len(classes), width + 1, c)
    weights = np.zeros((len(classes), width + 1))
    objective, gradient = problem.at(weights)
    first = np.linalg.norm(gradient, axis=1)
    for _ in range(MAX_STEPS):
        norm = np.linalg.norm(gradient, axis=1)
        if (norm <= tolerance * np.maximum(first, 1.0)).all():
            break
        step = problem.newton_step(weights, gradient, norm / np.maximum(first, 1e-300))
        slope = (gradient * step).sum(axis=1)
        size = np.ones(len(classes))
        while True:
            there = weights + size[:, None] * step
            objective_there, gradient_there = problem.at(there)
            # At the optimum differences are lost in rounding.
            fine = objective_there <= objective + 1e-4 * size * slope + 1e-12 * np.abs(objective)
            if fine.all() or size.max() < 1e-6:
                break
            size = np.where(fine, size, size / 2)
        weights, objective, gradient = there, objective_there, gradient_there
    return LinearModel(classes, weights.tolist(), np.linalg.norm(gradient, axis=1).tolist())


def support_vector_labels(rows: DataFrame, model: LinearModel, key: str, values: str = "values") -> DataFrame:
    """(id, label): the label whose weights score a vector highest, the smallest of equals."""
    filled = F.transform(F.col(values).cast("array<double>"), lambda v: F.coalesce(v, F.lit(0.0)))
    extended = rows.select(key, F.concat(filled, F.array(F.lit(1.0))).alias("values"))
    places = linear_labels(extended, model.weights, key)
    return places.select("id", F.get(F.lit(model.classes), F.col("label")).alias("label"))


def is_optimal(model: LinearModel, tolerance: float) -> bool:
    """Whether all gradients vanish but for ``tolerance``."""
    return all(math.isfinite(g) and g <= tolerance for g in model.gradient)


__all__ = ["LinearModel", "is_optimal", "support_vector_labels", "train_support_vectors"]
