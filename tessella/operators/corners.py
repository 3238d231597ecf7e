"""Oriented corners over a pyramid, and binary descriptors of their surroundings.

Corners of all levels are found with the segment test; each level keeps its
share of the wanted number, the strongest first, and corners that equal the
last stay too. A descriptor compares pairs of places in the smoothed image,
turned by the corner's direction. Which pairs is a parameter: a descriptor can
be compared with others of the same pattern alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import matching
from tessella.operators import neighbourhood as N
from tessella.operators.tiles import Tile, over_tiles

#: Diameter of the patch that gives a corner its direction.
PATCH = 31
#: Corners that a level keeps at least.
LEAST = 10


def pattern(pairs: int = 256, radius: int = 13, seed: int = 7) -> np.ndarray:
    """Pairs of places (ax, ay, bx, by) around a corner: normal draws, cut to the radius."""
    draws = np.random.default_rng(seed).normal(0, radius / 2.5, (pairs, 4))
    return np.clip(np.rint(draws), -radius, radius).astype(np.int64)


def _levels(size: tuple[int, int], factor: float, levels: int) -> list[tuple[float, int, int]]:
    """Scale, height and width of each level."""
    return [(factor**n, max(1, int(size[0] * factor**n)), max(1, int(size[1] * factor**n))) for n in range(levels)]


def _round(x: np.ndarray) -> np.ndarray:
    """Nearest whole numbers, halves away from zero."""
    return np.where(x >= 0, np.floor(x + 0.5), np.ceil(x - 0.5)).astype(np.int64)


def detect(px: DataFrame, size: tuple[int, int], *, wanted: int = 2000, factor: float = 0.83, levels: int = 8, threshold: int = 20, arc: int = 9, patch: int = PATCH) -> DataFrame:
    """Corners of images of one size: img, level, y, x (in the level), strength, angle (degrees), and ``y0``, ``x0`` in the image.

    Corners nearer to a level's border than half the patch and a little are
    left out, after the strongest have been chosen.
    """
    out = None
    total = sum(factor**n for n in range(levels))
    for n, (scale, h, w) in enumerate(_levels(size, factor, levels)):
        level = px if n == 0 else N.resize_bilinear(px, size[1], size[0], w, h)
        peaks = N.strict_peaks(N.fast_corners(level, threshold, arc), "strength")
        best = matching.best_with_ties(peaks, max(LEAST, int(wanted / total * scale + 0.5)), "img", "strength")
        inside = matching.away_from_border(best, w, h, (patch + 5) // 2)
        turned = inside.join(N.patch_orientation(level, patch).select(*N.KEY, "angle"), list(N.KEY))
        found = turned.select("img", F.lit(n).alias("level"), "y", "x", "strength", "angle", (F.col("y") / scale).alias("y0"), (F.col("x") / scale).alias("x0"))
        out = found if out is None else out.unionByName(found)
    return out


def describe(px: DataFrame, corners: DataFrame, size: tuple[int, int], *, factor: float = 0.83, levels: int = 8, pairs: np.ndarray | None = None) -> DataFrame:
    """``corners`` (of ``detect``) with ``bits``: one for each pair, 1 where the first place is darker than the second, as bytes.

    Each level is smoothed first by a bell of 5 cells and deviation 2 in fixed
    point. Corners whose pairs leave the image have no descriptor and go.
    """
    pairs = pattern() if pairs is None else np.asarray(pairs)
    reach = int(np.ceil(np.hypot(*np.abs(pairs).reshape(-1, 2).max(axis=0)))) + 1
    kernel = [int(k * 0xFFFF) for k in N.gaussian_kernel(5, 2.0)]
    words = -(-len(pairs) // 64)
    out = None

    def work(t: Tile):
        here = t.there() & ~np.isnan(t.near(0, 0, "turn")) & (t.near(0, 0, "turn") >= 0)
        columns = {f"w{k}": np.zeros(here.shape, np.int64) for k in range(words)}
        for y, x in zip(*np.nonzero(here), strict=True):
            turn = np.radians(t.near(0, 0, "turn")[y, x])
            c, s = np.float32(np.cos(turn)), np.float32(np.sin(turn))
            ax, ay, bx, by = (pairs[:, i].astype(np.float32) for i in range(4))
            places = [(_round(ax * s + ay * c), _round(ax * c - ay * s)), (_round(bx * s + by * c), _round(bx * c - by * s))]
            at = [(y + t.halo + dy, x + t.halo + dx) for dy, dx in places]
            if not all(t.whole[p].all() for p in at):
                here[y, x] = False
                continue
            first, second = (t.arrays["v"][p] for p in at)
            bits = np.packbits(np.pad(first < second, (0, 64 * words - len(pairs))), bitorder="little").view("<i8")
            for k in range(words):
                columns[f"w{k}"][y, x] = bits[k]
        return here, columns

    for n, (_, h, w) in enumerate(_levels(size, factor, levels)):
        level = px if n == 0 else N.resize_bilinear(px, size[1], size[0], w, h)
        smooth = N.correlate_fixed(N.correlate_fixed(level, kernel, False, (h, w)), kernel, True, (h, w))
        own = corners.where(F.col("level") == n)
        marked = smooth.join(own.select(*N.KEY, F.col("angle").alias("turn")), list(N.KEY), "left").fillna(-1.0, ["turn"])
        got = over_tiles(marked, reach, work, ", ".join(f"w{k} long" for k in range(words)), ("v", "turn"))
        # the words' bytes, lowest first
        hexed = [F.lpad(F.hex(F.col(f"w{k}")), 16, "0") for k in range(words)]
        text = F.concat(*[F.concat(*[F.substring(x, 15 - 2 * i, 2) for i in range(8)]) for x in hexed])
        found = own.join(got.select(*N.KEY, F.unhex(text).alias("bits")), list(N.KEY))
        out = found if out is None else out.unionByName(found)
    return out


def numbered(described: DataFrame) -> DataFrame:
    """Descriptors as rows for ``matching.nearest`` with the metric "hamming": ``vec_id`` tells image, level and place (below 65,536)."""
    place = F.col("img").cast("long") * (1 << 36) + F.col("level") * (1 << 32) + F.col("y") * (1 << 16) + F.col("x")
    return described.withColumn("vec_id", place).withColumnRenamed("bits", "e")
