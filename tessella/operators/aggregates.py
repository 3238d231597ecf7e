"""Aggregations over pixels, vectors and point sets."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(px: DataFrame) -> DataFrame:
    """Pixels of each value 0..255, zeros included."""
    every = px.select("img").distinct().withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return every.join(px.groupBy("img", "v").agg(F.count(F.lit(1)).alias("n")), ["img", "v"], "left").fillna(0, ["n"])


def projection(px: DataFrame, axis: str) -> DataFrame:
    return px.groupBy("img", axis).agg(F.sum("v").alias("s"))


def otsu(px: DataFrame) -> DataFrame:
    """Each image's threshold of greatest variance between classes, the lowest of equals; sums are 64-bit."""
    own = Window.partitionBy("img")
    run = own.orderBy("v")
    h = histogram(px).withColumn("n0", F.sum("n").over(run)).withColumn("s0", F.sum(F.col("n") * F.col("v")).over(run)).withColumn("n_all", F.sum("n").over(own)).withColumn("s_all", F.sum(F.col("n") * F.col("v")).over(own))
    n1 = F.col("n_all") - F.col("n0")
    gap = F.col("s0") / F.col("n0").cast("double") - (F.col("s_all") - F.col("s0")) / n1.cast("double")
    between = h.where((F.col("n0") > 0) & (n1 > 0)).select("img", "v", F.round(F.col("n0").cast("double") * n1 * gap * gap, 3).alias("b"))
    return between.groupBy("img").agg(F.max_by("v", F.struct(F.col("b"), -F.col("v"))).alias("threshold"))


def binarise(px: DataFrame, thresholds: DataFrame) -> DataFrame:
    """255 above the image's threshold, else 0."""
    return px.join(thresholds, "img").select("img", "y", "x", F.when(F.col("v") > F.col("threshold"), 255).otherwise(0).alias("v"))


def equalise(px: DataFrame) -> DataFrame:
    """Histogram equalisation: a value becomes its cumulated count, scaled to 255 and cut."""
    run = Window.partitionBy("img").orderBy("v")
    counts = px.groupBy("img", "v").agg(F.count(F.lit(1)).alias("n"))
    table = counts.withColumn("to", F.floor(F.sum("n").over(run) * 255 / F.sum("n").over(Window.partitionBy("img"))).cast("int")).select("img", "v", "to")
    return px.join(table, ["img", "v"]).select("img", "y", "x", F.col("to").alias("v"))


def moments(px: DataFrame, by: list[str]) -> DataFrame:
    """Raw moments to order 2, skewness and orientation."""
    x, y, v = (F.col(c).cast("long") for c in "xyv")
    m = px.groupBy(*by).agg(F.sum(v).alias("m00"), F.sum(v * x).alias("m10"), F.sum(v * y).alias("m01"), F.sum(v * x * y).alias("m11"), F.sum(v * x * x).alias("m20"), F.sum(v * y * y).alias("m02"))
    d = lambda c: F.col(c).cast("double")
    cx, cy = F.try_divide(d("m10"), d("m00")), F.try_divide(d("m01"), d("m00"))
    u11, u20, u02 = d("m11") - cx * d("m01"), d("m20") - cx * d("m10"), d("m02") - cy * d("m01")
    skew = F.when((F.abs(u02) <= 1e-9) | (F.col("m00") == 0), 0.0).otherwise(F.try_divide(u11, u02))
    turn = F.when(F.abs(u20 - u02) <= 1e-9, 0.0).otherwise(0.5 * F.atan2(2 * u11, u20 - u02))
    return m.withColumn("skewness", F.coalesce(skew, F.lit(0.0))).withColumn("orientation", F.coalesce(turn, F.lit(0.0)))


def colinear(points: DataFrame, by: str, eps: float = 1e-9) -> DataFrame:
    """Whether all points of a set lie on one line: the determinant of their scatter is at most ``eps`` times its trace squared."""
    m = points.groupBy(by).agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    return m.select(by, (F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy") <= eps * (F.col("xx") + F.col("yy")) * (F.col("xx") + F.col("yy"))).alias("colinear"))


def digests(px: DataFrame, size: tuple[int, int]) -> DataFrame:
    """MD5 of each image's bytes, row by row; a missing cell is 0. An image's bytes meet in one task."""
    h, w = size

    def one(key, table):
        a = np.zeros((h, w), np.uint8)
        y, x, v = (table.column(c).to_numpy() for c in "yxv")
        a[y, x] = v
        return pa.table({"img": pa.array([key[0].as_py()], table.schema.field("img").type), "md5": pa.array([hashlib.md5(a.tobytes(), usedforsecurity=False).hexdigest()])})

    kind = px.schema["img"].dataType.simpleString()
    return px.select("img", "y", "x", "v").groupBy("img").applyInArrow(one, f"img {kind}, md5 string")


def boxes(px: DataFrame, by: list[str]) -> DataFrame:
    return px.groupBy(*by).agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"), F.count(F.lit(1)).alias("area"))


def hartley(points: DataFrame, by: str) -> DataFrame:
    """Centroid, and the scale that makes the mean distance to it the root of 2.

    Two aggregations that combine on the map side; a set's centroid is one row
    that its points are joined with.
    """
    centre = points.groupBy(by).agg(F.avg("x").alias("tx"), F.avg("y").alias("ty"))
    far = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    return points.join(centre, by).groupBy(by).agg(F.first("tx").alias("tx"), F.first("ty").alias("ty"), F.try_divide(F.sqrt(F.lit(2.0)), F.avg(far)).alias("s"))


def variance_about(x: Column, mean: float) -> Column:
    """Sample variance about a given mean."""
    return F.try_divide(F.sum((x - mean) * (x - mean)), F.count(x) - 1)


def covariance(cells: DataFrame, dims: int) -> DataFrame:
    """Sample covariance of vectors (e) of ``dims`` components: cells (i, j, cov) with i <= j.

    Each task sums the products of its vectors, less one vector that is taken
    from all of them so that large means don't cancel: one row for each pair of
    dimensions leaves a task, whatever it has read.
    """
    some = cells.select("e").first()
    origin = np.array(some.e if some else [0.0] * dims, float)

    def work(batches):
        total, sums, n = np.zeros((dims, dims)), np.zeros(dims), 0
        for batch in batches:
            m = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), dims) - origin
            total += m.T @ m
            sums += m.sum(axis=0)
            n += len(m)
        if n:
            i, j = np.triu_indices(dims)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j]), pa.array(sums[i]), pa.array(sums[j]), pa.array(np.full(len(i), n))], ["i", "j", "p", "si", "sj", "n"])

    summed = cells.select("e").mapInArrow(work, "i int, j int, p double, si double, sj double, n long").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("p", "si", "sj", "n")])
    return summed.select("i", "j", F.try_divide(F.col("p") - F.col("si") * F.col("sj") / F.col("n"), F.col("n") - 1).alias("cov"))


def transposed(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Matrices of cells (by, i, j, v) with rows and columns changed."""
    keys = [c for c in cells.columns if c not in ("i", "j", "v")] if not by else by
    return cells.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "v")


def gram(a: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns against columns: the transpose times the matrix."""
    return matrix_product(transposed(a, by), a, by)


def is_symmetric(cells: DataFrame, by: str, eps: float = 0.0) -> DataFrame:
    """For each matrix (by, i, j, v), whether it equals its transpose; a cell without a counterpart counts as unequal."""
    other = cells.select(by, F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    return cells.join(other, [by, "i", "j"], "left").groupBy(by).agg(F.bool_and(F.coalesce(F.abs(F.col("v") - F.col("w")) <= eps, F.lit(False))).alias("symmetric"))


def off_diagonal(cells: DataFrame, by: str) -> DataFrame:
    """Place and size of the greatest cell off the diagonal, by absolute value; ties to the first row, then column."""
    best = F.max(F.struct(F.abs("v").alias("most"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j")))
    return cells.where("i <> j").groupBy(by).agg(best.alias("b")).select(by, (-F.col("b.i")).alias("i"), (-F.col("b.j")).alias("j"), F.col("b.most").alias("most"))


def matrix_product(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Products of matrices held as cells (by, i, j, v); a missing cell is 0."""
    right = b.select(*by, F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("w"))
    left = a.select(*by, F.col("i").alias("r"), F.col("j").alias("k"), "v")
    return left.join(right, [*by, "k"]).groupBy(*by, F.col("r").alias("i"), F.col("c").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def fit_line(points: DataFrame, by: str) -> DataFrame:
    """Total least squares: the line's direction and the centroid on it."""
    m = points.groupBy(by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    return m.select(by, "cx", "cy", (0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))).alias("angle"))


def fit_parabola(points: DataFrame, by: str) -> DataFrame:
    """Least squares for y = a x^2 + b x + c, from sums about the mean of x; null where x takes fewer than three values."""
    centre = points.groupBy(by).agg(F.avg("x").alias("x0"))
    p = points.join(centre, by).withColumn("u", F.col("x") - F.col("x0"))
    u, y = F.col("u"), F.col("y")
    s = p.groupBy(by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.first("x0").alias("x0"), F.countDistinct("x").alias("k"), F.sum(u**2).alias("s2"), F.sum(u**3).alias("s3"), F.sum(u**4).alias("s4"), F.sum(y).alias("t0"), F.sum(u * y).alias("t1"), F.sum(u * u * y).alias("t2"))
    c = F.col
    det = c("n") * c("s2") * c("s4") - c("s2") ** 3 - c("n") * c("s3") ** 2
    a = F.when(c("k") >= 3, F.try_divide(c("n") * c("s2") * c("t2") - c("n") * c("s3") * c("t1") - c("s2") ** 2 * c("t0"), det))
    s = s.withColumn("a", a).withColumn("bu", F.try_divide(c("t1") - c("a") * c("s3"), c("s2")))
    s = s.withColumn("cu", (c("t0") - c("a") * c("s2")) / c("n"))
    return s.select(by, "a", (c("bu") - 2 * c("a") * c("x0")).alias("b"), (c("cu") - c("bu") * c("x0") + c("a") * c("x0") ** 2).alias("c"))
