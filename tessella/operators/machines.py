"""Kernel machines: trained on a bounded set of labelled vectors, chosen by cross-validation, applied to any table.

Training holds all products of its vectors, so it takes at most ``ROWS`` of
them; that bound is a parameter. Cross-validation trains each fold of each
setting in a task of its own. Prediction reads a table in blocks.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled vectors that a machine is trained on, at most.
ROWS = 4000
KERNELS = ("linear", "poly", "rbf", "sigmoid")
_LEAST = 1e-12


def products(a: np.ndarray, b: np.ndarray, kernel: str, gamma: float, offset: float = 0.0, degree: int = 3) -> np.ndarray:
    """The kernel of all rows of ``a`` with all rows of ``b``."""
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel}")
    dots = a @ b.T
    if kernel == "linear":
        return dots
    if kernel == "rbf":
        return np.exp(-gamma * np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * dots, 0.0))
    return (gamma * dots + offset) ** degree if kernel == "poly" else np.tanh(gamma * dots + offset)


def solve(k: np.ndarray, y: np.ndarray, c: float, eps: float = 1e-3, most: int = 1_000_000) -> tuple[np.ndarray, float]:
    """Multipliers and offset of the soft-margin machine for labels +1 and -1.

    Two multipliers are moved at a time: the one that violates the optimality
    conditions most, and the one that with it lowers the objective most. Ends
    when the greatest violation is below ``eps``.
    """
    n = len(y)
    q = k * np.outer(y, y)
    alpha, slope = np.zeros(n), -np.ones(n)
    for _ in range(most):
        up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
        low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
        pull = -y * slope
        if not up.any() or not low.any():
            break
        i = int(np.where(up, pull, -np.inf).argmax())
        gap = pull[i] - pull
        if np.where(low, gap, -np.inf).max() < eps:
            break
        curve = np.maximum(k[i, i] + np.diag(k) - 2 * k[i], _LEAST)
        j = int(np.where(low & (gap > 0), gap * gap / curve, -np.inf).argmax())
        step = gap[j] / curve[j]
        step = min(step, c - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        slope += step * (y[i] * q[:, i] - y[j] * q[:, j])
    free = (alpha > 0) & (alpha < c)
    pull = -y * slope
    if free.any():
        return alpha, float(pull[free].mean())
    up, low = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0)), ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
    return alpha, float((pull[up].max(initial=0.0) + pull[low].min(initial=0.0)) / 2)


@dataclass
class Machine:
    """A trained machine: for each pair of classes, vectors' weights and an offset."""

    kernel: str
    gamma: float
    classes: list[int]
    vectors: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray

    def decisions(self, x: np.ndarray) -> np.ndarray:
        """A value for each row and pair of classes; above 0 speaks for the pair's first."""
        return products(x, self.vectors, self.kernel, self.gamma) @ self.weights.T + self.offsets

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The class with most pairs won, the first of equals."""
        votes = np.zeros((len(x), len(self.classes)), np.int64)
        pairs = [(a, b) for a in range(len(self.classes)) for b in range(a + 1, len(self.classes))]
        for (a, b), d in zip(pairs, self.decisions(x).T, strict=True):
            votes[:, a] += d > 0
            votes[:, b] += d <= 0
        return np.array(self.classes)[votes.argmax(axis=1)]

    def to_json(self) -> str:
        return json.dumps({"kernel": self.kernel, "gamma": self.gamma, "classes": self.classes, "vectors": self.vectors.tolist(), "weights": self.weights.tolist(), "offsets": self.offsets.tolist()})

    @staticmethod
    def from_json(text: str) -> Machine:
        d = json.loads(text)
        return Machine(d["kernel"], d["gamma"], d["classes"], np.array(d["vectors"]).reshape(len(d["vectors"]), -1), np.array(d["weights"]).reshape(len(d["offsets"]), -1), np.array(d["offsets"]))


def train(x: np.ndarray, labels: np.ndarray, *, c: float = 1.0, gamma: float | None = None, kernel: str = "rbf", eps: float = 1e-3, rows: int = ROWS) -> Machine:
    """A machine for each pair of classes; ``gamma`` is one over the length of vectors unless given."""
    if len(x) > rows:
        raise ValueError(f"{len(x)} vectors are more than {rows}")
    gamma = 1.0 / max(x.shape[1], 1) if gamma is None else gamma
    classes = sorted(set(labels.tolist()))
    k = products(x, x, kernel, gamma)
    weights, offsets = [], []
    for a in range(len(classes)):
        for b in range(a + 1, len(classes)):
            own = np.flatnonzero((labels == classes[a]) | (labels == classes[b]))
            y = np.where(labels[own] == classes[a], 1.0, -1.0)
            alpha, offset = solve(k[np.ix_(own, own)], y, c, eps)
            w = np.zeros(len(x))
            w[own] = alpha * y
            weights.append(w)
            offsets.append(offset)
    w = np.array(weights).reshape(len(offsets), len(x))
    used = np.flatnonzero((w != 0).any(axis=0))
    return Machine(kernel, gamma, classes, x[used], w[:, used], np.array(offsets))


def gathered(vectors: DataFrame, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The first ``rows`` labelled vectors (vec_id, e, label) by id, for training; rows with nulls are left out."""
    got = vectors.dropna(subset=["vec_id", "e", "label"]).orderBy("vec_id").limit(rows).select("e", "label").collect()
    return np.array([r.e for r in got], float).reshape(len(got), -1), np.array([r.label for r in got])


def cross_validate(vectors: DataFrame, settings: Iterable[tuple[float, float]], *, folds: int = 5, kernel: str = "rbf", rows: int = ROWS) -> DataFrame:
    """Accuracy of each setting (c, gamma): each vector is predicted by a machine trained on the other folds, which are drawn the same way each time. Columns c, gamma, accuracy."""
    spark = vectors.sparkSession
    x, labels = gathered(vectors, rows)
    sent = spark.sparkContext.broadcast((x, labels))
    grid = [(float(c), float(g), f) for c, g in settings for f in range(folds)]

    def work(batches):
        x, labels = sent.value
        fold = np.random.default_rng(0).permutation(len(x)) % folds
        for batch in batches:
            right = []
            for c, gamma, f in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                rest, own = fold != f, fold == f
                machine = train(x[rest], labels[rest], c=c, gamma=gamma, kernel=kernel, rows=rows)
                right.append(int((machine.predict(x[own]) == labels[own]).sum()) if own.any() else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(right, pa.int64())], ["c", "gamma", "right"])

    tasks = spark.createDataFrame(grid, "c double, gamma double, fold int").repartition(len(grid), "c", "gamma", "fold")
    return tasks.mapInArrow(work, "c double, gamma double, right long").groupBy("c", "gamma").agg((F.sum("right") / F.lit(max(len(x), 1))).alias("accuracy"))


def best_setting(accuracies: DataFrame) -> tuple[float, float]:
    """The (c, gamma) of greatest accuracy; of equals the least c, then gamma."""
    r = accuracies.agg(F.min_by(F.struct("c", "gamma"), F.struct(-F.col("accuracy"), F.col("c"), F.col("gamma"))).alias("s")).first().s
    return r.c, r.gamma


def predicted(vectors: DataFrame, machine: Machine) -> DataFrame:
    """``label`` for every vector (vec_id, e); a null vector has none."""
    sent = vectors.sparkSession.sparkContext.broadcast(machine)

    def work(batches):
        for batch in batches:
            some = batch.filter(batch.column(1).is_valid())
            if len(some):
                x = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(some), -1)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sent.value.predict(x), pa.int64())], ["vec_id", "label"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("e").cast("array<double>").alias("e")).mapInArrow(work, "vec_id long, label long")
