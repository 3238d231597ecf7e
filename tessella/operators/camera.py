"""Rotations, the pinhole camera with lens distortion, homographies, and robust line fits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import pixel
from tessella.operators import aggregates, robust


def rotation_matrix(x: Column, y: Column, z: Column) -> list[Column]:
    """A rotation vector as a 3x3 matrix, row by row; the zero vector gives the identity."""
    turn = F.sqrt(x * x + y * y + z * z)
    a, b, c = (F.coalesce(F.try_divide(k, turn), F.lit(0.0)) for k in (x, y, z))
    s, q = F.sin(turn), 1 - F.cos(turn)
    return [1 - q * (b * b + c * c), q * a * b - s * c, q * a * c + s * b, q * a * b + s * c, 1 - q * (a * a + c * c), q * b * c - s * a, q * a * c - s * b, q * b * c + s * a, 1 - q * (a * a + b * b)]


def rotation_vector(r: Sequence[Column]) -> list[Column]:
    """The rotation vector of a 3x3 matrix, for turns below half a circle."""
    turn = F.acos(F.greatest(F.least((r[0] + r[4] + r[8] - 1) / 2, F.lit(1.0)), F.lit(-1.0)))
    k = F.coalesce(F.try_divide(turn, 2 * F.sin(turn)), F.lit(0.0))
    return [(r[7] - r[5]) * k, (r[2] - r[6]) * k, (r[3] - r[1]) * k]


def distort(x: Column, y: Column, k1: float, k2: float, p1: float = 0.0, p2: float = 0.0) -> tuple[Column, Column]:
    """Radial and tangential lens distortion of a point on the plane at depth 1."""
    r2 = x * x + y * y
    radial = 1 + k1 * r2 + k2 * r2 * r2
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def project(point: Sequence[Column], rotation: Sequence[Column], shift: Sequence[float], focal: tuple[float, float], centre: tuple[float, float], skew: float = 0.0, lens: Sequence[float] = (0.0, 0.0, 0.0, 0.0)) -> tuple[Column, Column]:
    """Where a camera sees a point of space; null at depth 0."""
    x, y, z = (sum((rotation[3 * i + j] * point[j] for j in range(1, 3)), rotation[3 * i] * point[0]) + shift[i] for i in range(3))
    u, v = distort(F.try_divide(x, z), F.try_divide(y, z), *lens)
    return focal[0] * u + skew * v + centre[0], focal[1] * v + centre[1]


def undistortion_map(width: int, height: int, focal: tuple[float, float], centre: tuple[float, float], lens: Sequence[float], spark) -> DataFrame:
    """For each pixel (y, x) of the straightened image, where to read (sy, sx) in the distorted one."""
    grid = spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    u, v = distort((F.col("x") - centre[0]) / focal[0], (F.col("y") - centre[1]) / focal[1], *lens)
    return grid.select("y", "x", (v * focal[1] + centre[1]).alias("sy"), (u * focal[0] + centre[0]).alias("sx"))


def homography(pairs: DataFrame, by: str) -> DataFrame:
    """The 3x3 map (h, row by row, last cell 1) that best takes (x, y) to (u, v) in each set.

    Both sides are moved and scaled first. The normal matrix of the direct
    linear transform is 45 sums, so all points are read in aggregations that
    combine on the map side; only its 9x9 cells reach the eigenvector step.
    Sets of fewer than four pairs, or with all points on one place, give no row.
    """
    full = pairs.dropna(subset=["x", "y", "u", "v"])
    src = aggregates.hartley(full.select(by, "x", "y"), by)
    dst = aggregates.hartley(full.select(by, F.col("u").alias("x"), F.col("v").alias("y")), by)
    frame = src.join(dst.select(by, F.col("tx").alias("du"), F.col("ty").alias("dv"), F.col("s").alias("ds")), by).where("s IS NOT NULL AND ds IS NOT NULL")
    p = full.join(frame, by).select(by, *[((F.col(c) - F.col(t)) * F.col(s)).alias(c) for c, t, s in (("x", "tx", "s"), ("y", "ty", "s"), ("u", "du", "ds"), ("v", "dv", "ds"))])
    x, y, u, v, one, none = F.col("x"), F.col("y"), F.col("u"), F.col("v"), F.lit(1.0), F.lit(0.0)
    rows = [[-x, -y, -one, none, none, none, u * x, u * y, u], [none, none, none, -x, -y, -one, v * x, v * y, v]]
    cells = [F.sum(rows[0][i] * rows[0][j] + rows[1][i] * rows[1][j]).alias(f"m{i}{j}") for i in range(9) for j in range(i, 9)]
    sums = p.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *cells).where("n >= 4").join(frame, by)

    def solve(batches):
        for f in batches:
            out = []
            for r in f.to_dict("records"):
                m = np.zeros((9, 9))
                for i in range(9):
                    for j in range(i, 9):
                        m[i, j] = m[j, i] = r[f"m{i}{j}"]
                h = np.linalg.eigh(m)[1][:, 0].reshape(3, 3)
                to = np.array([[r["s"], 0, -r["s"] * r["tx"]], [0, r["s"], -r["s"] * r["ty"]], [0, 0, 1]])
                back = np.array([[1 / r["ds"], 0, r["du"]], [0, 1 / r["ds"], r["dv"]], [0, 0, 1]])
                h = back @ h @ to
                if abs(h[2, 2]) > 1e-300:
                    out.append((r[by], (h / h[2, 2]).reshape(-1).tolist()))
            yield pd.DataFrame(out, columns=[by, "h"])

    return sums.mapInPandas(solve, f"{by} {full.schema[by].dataType.simpleString()}, h array<double>")


def fit_line_robust(points: DataFrame, by: str, within: float, trials: int = 32) -> DataFrame:
    """Random sample consensus for a line: trials through two points each, the one with most points near wins, and those are fitted again.

    Trials draw points by a hash of the row, so reruns agree. Drawing is one
    aggregation and counting another; no group is held in one task. Rows with
    null coordinates take no part. Returns by, cx, cy, angle, n (points near).
    """
    own = points.dropna(subset=["x", "y"])
    place = F.struct("x", "y")
    draw = lambda k, side: F.min_by(place, F.xxhash64("x", "y", F.lit(2 * k + side)))
    drawn = own.groupBy(by).agg(F.array(*[F.struct(draw(k, 0).alias("a"), draw(k, 1).alias("b")) for k in range(trials)]).alias("draws"))
    far = lambda a, b: F.try_divide(F.abs((b["y"] - a["y"]) * (F.col("x") - a["x"]) - (b["x"] - a["x"]) * (F.col("y") - a["y"])), F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    both = own.join(drawn, by)
    near = lambda k: F.col("draws")[k]
    votes = both.groupBy(by).agg(F.array(*[F.count(F.when(far(near(k)["a"], near(k)["b"]) <= within, 1)) for k in range(trials)]).alias("votes"))
    best = votes.join(drawn, by).select(by, F.element_at("draws", F.array_position("votes", F.array_max("votes")).cast("int")).alias("line"))
    kept = own.join(best, by).where(far(F.col("line")["a"], F.col("line")["b"]) <= within)
    return aggregates.fit_line(kept, by).join(kept.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by)


def homography_robust(pairs: DataFrame, by: str, within: float, trials: int = robust.TRIALS) -> DataFrame:
    """``homography`` of the pairs that agree with the best of some maps through four pairs; with ``n``, how many agree."""
    agree = robust.consensus(pairs, by, ["x", "y", "u", "v"], 4, robust.homography_through, robust.homography_residual, within, trials=trials)
    return homography(agree.drop("model"), by).join(agree.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by)


def fit_parabola_robust(points: DataFrame, by: str, within: float, trials: int = robust.TRIALS) -> DataFrame:
    """Least squares over the points that agree with the best of some parabolas through three points; with ``n``, how many agree."""
    agree = robust.consensus(points, by, ["x", "y"], 3, robust.parabola_through, robust.parabola_residual, within, trials=trials)
    return aggregates.fit_parabola(agree.drop("model"), by).join(agree.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by)


def inverse_3x3(m: Sequence[Column]) -> list[Column]:
    """Inverse of a 3x3 matrix of columns, row by row; null where it is singular."""
    minor = lambda i, j, k, l: m[i] * m[l] - m[j] * m[k]  # noqa: E731, E741
    det = m[0] * minor(4, 5, 7, 8) - m[1] * minor(3, 5, 6, 8) + m[2] * minor(3, 4, 6, 7)
    cofactors = [minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5), -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5), minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4)]
    return [F.try_divide(c, det) for c in cofactors]


def transfer_error(pairs: DataFrame, by: str, h: Sequence[float]) -> DataFrame:
    """Mean squared distance between mapped (x, y) and (u, v)."""
    a, b = pixel.perspective(list(h), F.col("x"), F.col("y"))
    return pairs.groupBy(by).agg(F.avg((a - F.col("u")) ** 2 + (b - F.col("v")) ** 2).alias("mse"))
