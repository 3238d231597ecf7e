"""Eigenvectors, principal components and singular values of matrices with a bounded side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import aggregates

#: Largest side of a matrix that one task decomposes (128 MB of doubles).
SIDE = 4096


def eigen_symmetric(cells: DataFrame, by: str) -> DataFrame:
    """Eigenvalues and vectors of symmetric matrices given by cells (by, i, j, v), of which i <= j suffice.

    Largest value first; a vector's component of greatest size is positive.
    A matrix is decomposed in one task and must not be wider than ``SIDE``.
    """

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        n = int(max(f["i"].max(), f["j"].max())) + 1
        if n > SIDE:
            raise ValueError(f"a matrix of side {n} is wider than {SIDE}")
        m = np.zeros((n, n))
        m[f["i"], f["j"]] = m[f["j"], f["i"]] = f["v"]
        values, vectors = np.linalg.eigh(m)
        values, vectors = values[::-1], vectors.T[::-1]
        sign = np.sign(vectors[np.arange(n), np.abs(vectors).argmax(axis=1)])
        return pd.DataFrame({by: f[by].iloc[0], "k": np.arange(n), "value": values, "vector": list(vectors * sign[:, None])})

    kind = cells.schema[by].dataType.simpleString()
    slim = cells.select(by, F.col("i").cast("int"), F.col("j").cast("int"), F.col("v").cast("double"))
    return slim.groupBy(by).applyInPandas(solve, f"{by} {kind}, k int, value double, vector array<double>")


def principal_components(vectors: DataFrame, dims: int, keep: int) -> DataFrame:
    """The ``keep`` directions of greatest variance of vectors (vec_id, e): k, value, vector."""
    cov = aggregates.covariance(vectors, dims).select(F.lit(0).alias("m"), "i", "j", F.col("cov").alias("v"))
    return eigen_symmetric(cov, "m").where(F.col("k") < keep).drop("m")


def project_components(vectors: DataFrame, components: DataFrame, dims: int) -> DataFrame:
    """Vectors less their mean, as coordinates (p) along components.

    Mean and components are one row of at most ``SIDE`` squared numbers and are sent along.
    """
    e = lambda i: F.get("e", F.lit(i))
    mean = vectors.agg(F.array(*[F.avg(e(i)) for i in range(dims)]).alias("mean"))
    model = components.agg(F.array_sort(F.collect_list(F.struct("k", "vector"))).alias("c")).join(F.broadcast(mean))
    centred = vectors.join(F.broadcast(model)).withColumn("d", F.zip_with("e", "mean", lambda a, b: a - b))
    along = F.transform("c", lambda c: F.aggregate(F.zip_with("d", c["vector"], lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    return centred.select("vec_id", along.alias("p"))


def singular_values(cells: DataFrame, by: str) -> DataFrame:
    """Singular values of matrices given by cells (by, i, j, v), largest first.

    Rows may be many: columns are multiplied by a join on the row, and only the
    product's cells meet in a task. Values under about 1e-8 of the largest drown in rounding.
    """
    a = cells.select(by, "i", F.col("j").alias("a"), F.col("v").cast("double").alias("va"))
    b = cells.select(by, "i", F.col("j").alias("b"), F.col("v").cast("double").alias("vb"))
    gram = a.join(b, [by, "i"]).where("a <= b").groupBy(by, F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum(F.col("va") * F.col("vb")).alias("v"))
    return eigen_symmetric(gram, by).select(by, "k", F.sqrt(F.greatest("value", F.lit(0.0))).alias("value"))
