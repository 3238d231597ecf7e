"""Neighbourhood operators on pixel tables (img, y, x, v).

Images are cut into tiles with margins (``tiles``), so one shuffle carries
little more than the pixels, whatever the size of a kernel, and a large image
is spread over all tasks. Sizes are (height, width) and hold for all images of
a table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import pixel
from tessella.operators import regions
from tessella.operators.tiles import Tile, over_tiles

KEY = ("img", "y", "x")
#: Offsets of 3x3 kernels, row by row.
NINE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
# fixed values: first-derivative kernels (smooth, derive)
KERNELS = {"sobel": (1, 2, 1), "scharr": (3, 10, 3), "prewitt": (1, 1, 1)}
#: The 16 places of a circle of radius 3, clockwise from the top.
RING = [(-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1)]
BORDERS = ("zero", "replicate", "ignore")
_TAN_LOW, _TAN_HIGH = 0.41421356237309503, 2.414213562373095


def _reach(offsets: Sequence[tuple[int, int]]) -> tuple[int, int]:
    return max(abs(dy) for dy, _ in offsets), max(abs(dx) for _, dx in offsets)


def _bordered(t: Tile, s: np.ndarray, own: np.ndarray, size: tuple[int, int], reach: tuple[int, int], border: str) -> tuple[np.ndarray, np.ndarray]:
    """Which cells are put out, and their values, by the border rule."""
    frame = t.frame(size, *reach)
    if border == "ignore":
        return t.there() & ~frame, s
    return t.there(), np.where(frame, 0 if border == "zero" else own, s)


def correlate(px: DataFrame, offsets: Sequence[tuple[int, int]], weights: Sequence[float], size: tuple[int, int], *, value: str = "v", border: str = "zero") -> DataFrame:
    """Sum ``s`` of weighted neighbours at every pixel; missing cells inside an image count 0.

    Where the kernel leaves the image, the result is 0, with the border
    "replicate" the pixel itself, and with "ignore" there is no row.
    """
    if border not in BORDERS:
        raise ValueError(f"unknown border {border}")
    whole = all(isinstance(w, int) for w in weights) and px.schema[value].dataType.simpleString() not in ("double", "float")
    reach = _reach(offsets)

    def work(t: Tile):
        s = sum(t.near(dy, dx, value) * w for (dy, dx), w in zip(offsets, weights, strict=True))
        keep, s = _bordered(t, s, t.near(0, 0, value), size, reach, border)
        return keep, {"s": s.astype(np.int64 if whole else np.float64)}

    return over_tiles(px, max(reach), work, "s long" if whole else "s double", (value,))


def correlate_fixed(px: DataFrame, kernel: Sequence[int], vertical: bool, size: tuple[int, int], *, border: str = "zero") -> DataFrame:
    """One pass of a separable kernel in 16-bit fixed point: each product is shifted before it is added, and the sum cut to 0..255."""
    half = len(kernel) // 2
    offsets = [(i - half, 0) if vertical else (0, i - half) for i in range(len(kernel))]

    def work(t: Tile):
        s = np.clip(sum(t.near(dy, dx) * k >> 16 for (dy, dx), k in zip(offsets, kernel, strict=True)), 0, 255)
        keep, s = _bordered(t, s, t.near(0, 0), size, _reach(offsets), border)
        return keep, {"v": s.astype(np.int32)}

    return over_tiles(px, half, work, "v int")


def gradients(px: DataFrame, name: str, size: tuple[int, int]) -> DataFrame:
    """Both first derivatives by a named 3x3 kernel: gx, gy; 0 on the image's frame."""
    a = KERNELS[name]

    def work(t: Tile):
        inside = ~t.frame(size, 1, 1)
        gx = sum(t.near(dy, dx) * (a[dy + 1] * dx) for dy, dx in NINE) * inside
        gy = sum(t.near(dy, dx) * (a[dx + 1] * dy) for dy, dx in NINE) * inside
        return t.there(), {"gx": gx, "gy": gy}

    return over_tiles(px, 1, work, "gx long, gy long")


def differences(px: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Differences gx of the neighbours in a row (0 in the first and last column) and gy of those in a column (0 in the first and last row)."""

    def work(t: Tile):
        gx = (t.near(0, 1) - t.near(0, -1)) * ~t.frame(size, 0, 1)
        gy = (t.near(1, 0) - t.near(-1, 0)) * ~t.frame(size, 1, 0)
        return t.there(), {"gx": gx, "gy": gy}

    return over_tiles(px, 1, work, "gx long, gy long")


def xor_above(px: DataFrame) -> DataFrame:
    """Each pixel XOR the one above it; a cell that isn't there counts 0."""

    def work(t: Tile):
        return t.there(), {"v": (t.near(0, 0) ^ t.near(-1, 0)).astype(np.int32)}

    return over_tiles(px, 1, work, "v int")


def polar(g: DataFrame, degrees: bool = True) -> DataFrame:
    """Magnitude and direction of derivatives gx, gy; directions in [0, 360), or in radians."""
    turn = pixel.degrees_of(F.col("gy").cast("double"), F.col("gx").cast("double"))
    return g.select(*KEY, F.hypot(F.col("gx").cast("double"), F.col("gy").cast("double")).alias("magnitude"), (turn if degrees else F.radians(turn)).alias("direction"))


def edges(px: DataFrame, name: str, size: tuple[int, int]) -> DataFrame:
    """Edge strength |gx| + |gy|, scaled so that each image's greatest is 255; all 0 where there is none."""
    g = gradients(px, name, size).withColumn("g", F.abs("gx") + F.abs("gy"))
    top = g.groupBy("img").agg(F.greatest(F.max("g"), F.lit(1)).alias("top"))
    return g.join(top, "img").select(*KEY, F.floor(F.col("g") * 255 / F.col("top")).cast("int").alias("v"))


def morph(px: DataFrame, op: str, shape: str = "rect", radius: int = 1) -> DataFrame:
    """erode, dilate, open, close, gradient, tophat or blackhat; only pixels count, as if the border were repeated."""
    r = range(-radius, radius + 1)
    inside = {"rect": lambda y, x: True, "cross": lambda y, x: y == 0 or x == 0, "diamond": lambda y, x: abs(y) + abs(x) <= radius}[shape]
    offsets = [(y, x) for y in r for x in r if inside(y, x)]

    halo = max(_reach(offsets))

    def spread(f, worst: int):
        def work(t: Tile):
            return f.reduce([np.where(t.there(dy, dx), t.near(dy, dx), worst) for dy, dx in offsets])

        return work

    low, high = spread(np.minimum, 1 << 40), spread(np.maximum, -(1 << 40))
    step = lambda d, f: over_tiles(d, halo, lambda t: (t.there(), {"v": f(t).astype(np.int32)}), "v int")
    steps = {"erode": [low], "dilate": [high], "open": [low, high], "close": [high, low]}
    if op == "gradient":
        return step(px, lambda t: high(t) - low(t))
    if op in ("tophat", "blackhat"):
        other = morph(px, "open" if op == "tophat" else "close", shape, radius).withColumnRenamed("v", "o")
        d = F.col("v") - F.col("o") if op == "tophat" else F.col("o") - F.col("v")
        return px.join(other, list(KEY)).select(*KEY, d.alias("v"))
    for f in steps[op]:
        px = step(px, f)
    return px


def integral(px: DataFrame) -> DataFrame:
    """Sums ``s`` of all pixels above and to the left, the own one not included, and ``q`` of their squares.

    The result is one row and one column larger than the image; its first row
    and column are 0. Running sums along rows, then along columns.
    """
    frame = px.groupBy("img").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    cells = frame.select("img", F.explode(F.sequence(F.lit(0), F.col("h"))).alias("y"), "w").select("img", "y", F.explode(F.sequence(F.lit(0), F.col("w"))).alias("x"))
    moved = px.select("img", (F.col("y") + 1).alias("y"), (F.col("x") + 1).alias("x"), F.col("v").cast("double").alias("v"))
    dense = cells.join(moved, list(KEY), "left").fillna(0.0, ["v"]).withColumn("u", F.col("v") * F.col("v"))
    row, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    along = dense.select(*KEY, F.sum("v").over(row).alias("v"), F.sum("u").over(row).alias("u"))
    return along.select(*KEY, F.sum("v").over(column).alias("s"), F.sum("u").over(column).alias("q"))


def mean_kernel(size: int) -> list[int]:
    """Equal weights in 16-bit fixed point, from a quotient of single precision."""
    if size % 2 == 0:
        raise ValueError("the size must be odd")
    return [int(np.float32(1) / np.float32(size) * np.float32(0xFFFF))] * size


def local_threshold(px: DataFrame, kernel: Sequence[int], delta: float, size: tuple[int, int], *, most: float = 255, invert: bool = False) -> DataFrame:
    """``most`` where a pixel less its neighbourhood's mean is above ``-delta``, else 0; the other way round with ``invert``.

    The mean is a fixed-point kernel along rows, then along columns, each cut
    to 8 bits; where the kernel leaves the image it is 0.
    """
    if len(kernel) % 2 == 0 or most < 0:
        raise ValueError("the kernel must be odd, and the value not negative")
    half, near = len(kernel) // 2, int(min(max(delta, 0), 255) + 0.5)
    yes, no = (0, int(min(most, 255) + 0.5)) if invert else (int(min(most, 255) + 0.5), 0)

    def work(t: Tile):
        rows = sum(t.near(0, i - half, margin=half)[:, half : half + t.side] * k >> 16 for i, k in enumerate(kernel))
        rows = np.minimum(rows, 255) * ~((t.x < half) | (t.x >= size[1] - half))
        mean = np.minimum(sum(rows[i : i + t.side] * k >> 16 for i, k in enumerate(kernel)), 255)
        mean = np.where(t.frame(size, half, 0), 0, mean)
        return t.there(), {"v": np.where(t.near(0, 0) - mean > -near, yes, no).astype(np.int32)}

    return over_tiles(px, 2 * half, work, "v int")


def local_mean_threshold(px: DataFrame, block: int, delta: float, size: tuple[int, int], *, most: float = 255, invert: bool = False) -> DataFrame:
    """``local_threshold`` with the mean of a square block."""
    return local_threshold(px, mean_kernel(block), delta, size, most=most, invert=invert)


def fast_corners(px: DataFrame, threshold: int = 20, arc: int = 9) -> DataFrame:
    """Corners by the segment test: ``arc`` neighbours in a row on the circle all brighter or all darker by more than the threshold.

    Strength is the largest margin that an arc as a whole holds, plus the
    threshold, less 1. Pixels whose circle has missing cells are no corners.
    """

    def work(t: Tile):
        d = np.stack([t.near(*RING[k % 16]) - t.near(0, 0) for k in range(16 + arc - 1)])
        best = np.full((t.side, t.side), -(1 << 40))
        for first in range(16):
            part = d[first : first + arc]
            best = np.maximum(best, np.maximum(part.min(axis=0), -part.max(axis=0)))
        whole = np.logical_and.reduce([t.there(*o) for o in RING]) & t.there()
        return whole & (best > threshold), {"strength": (best - 1).astype(np.int32)}

    return over_tiles(px, 3, work, "strength int")


def strict_peaks(px: DataFrame, value: str = "v") -> DataFrame:
    """Pixels greater than all eight neighbours; equal neighbours suppress each other."""

    def work(t: Tile):
        around = np.maximum.reduce([np.where(t.there(*o), t.near(*o, value), -1) for o in NINE if o != (0, 0)])
        return t.there() & (around < t.near(0, 0, value)), {value: t.near(0, 0, value)}

    kind = px.schema[value].dataType.simpleString()
    return over_tiles(px, 1, work, f"{value} {'double' if kind in ('double', 'float') else 'long'}", (value,)).withColumn(value, F.col(value).cast(kind))


def hog_cells(px: DataFrame, size: tuple[int, int], cell: int = 8, bins: int = 9) -> DataFrame:
    """Gradient orientation histograms of cells: unsigned directions in ``bins`` bins, weighted by magnitude."""
    g = differences(px, size)
    angle = F.pmod(F.degrees(F.atan2(F.col("gy").cast("double"), F.col("gx").cast("double"))) + 180.0, F.lit(180.0))
    binned = g.select("img", F.floor(F.col("y") / cell).alias("cy"), F.floor(F.col("x") / cell).alias("cx"), F.least(F.floor(angle / (180.0 / bins)), F.lit(bins - 1)).alias("bin"), F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")).alias("m"))
    return binned.groupBy("img", "cy", "cx", "bin").agg(F.sum("m").alias("weight"))


HOG_NORMS = ("none", "l1", "l1sqrt", "l2", "l2hys")


def hog_check(block: tuple[int, int], stride: tuple[int, int], cell: tuple[int, int], bins: int, norm: str = "none") -> None:
    """Raise ValueError unless sizes (height, width) fit each other: cells fill blocks, strides fill cells."""
    if not all((*block, *stride, *cell)):
        raise ValueError("sizes must not be 0")
    if any(b % c for b, c in zip(block, cell, strict=True)) or any(c % s for c, s in zip(cell, stride, strict=True)):
        raise ValueError("blocks must be whole cells, and cells whole strides")
    if not 2 <= bins <= 360 or norm not in HOG_NORMS:
        raise ValueError("between 2 and 360 bins, and a known norm")


def hog_length(window: tuple[int, int], block: tuple[int, int], stride: tuple[int, int], cell: tuple[int, int], bins: int) -> int:
    """How many numbers describe a window."""
    hog_check(block, stride, cell, bins)
    if any(w < b for w, b in zip(window, block, strict=True)):
        raise ValueError("the window must hold a block")
    out = bins
    for w, b, s, c in zip(window, block, stride, cell, strict=True):
        out *= (b // c) * ((w - b) // s + 1)
    return out


def hog_histograms(px: DataFrame, size: tuple[int, int], cell: int = 8, bins: int = 9, signed: bool = False) -> DataFrame:
    """Weights of each cell's bins (img, cy, cx, bin, weight): a pixel's magnitude is shared by the two bins nearest to its direction."""
    turn = 360 if signed else 180
    width = turn // bins
    g = polar(differences(px, size))
    theta = F.when(F.col("direction") > turn, F.col("direction") - turn).otherwise(F.col("direction"))
    first = (theta / width - 0.5).cast("int")
    apart = (theta - first * width) / width - 0.5
    beside = first + F.when(apart >= 0, 1).otherwise(-1)
    second = F.when(beside < 0, bins - 1).when(beside > bins - 1, 0).otherwise(beside)
    part = F.abs(F.col("magnitude") * apart)
    votes = F.array(F.struct(first.alias("bin"), (F.col("magnitude") - part).alias("w")), F.struct(second.alias("bin"), part.alias("w")))
    each = g.select("img", F.floor(F.col("y") / cell).cast("int").alias("cy"), F.floor(F.col("x") / cell).cast("int").alias("cx"), F.explode(votes).alias("t"))
    return each.groupBy("img", "cy", "cx", F.col("t.bin").alias("bin")).agg(F.sum("t.w").alias("weight"))


def hog_blocks(cells: DataFrame, grid: tuple[int, int], block: int = 2, norm: str = "l2hys", eps: float = 1e-6) -> DataFrame:
    """Normalised blocks of ``block`` x ``block`` cells, one cell apart: img, by, bx (first cell), dy, dx, bin, value.

    ``grid`` is how many rows and columns of cells there are. l1 divides by the
    sum plus eps, l1sqrt takes the root of that, l2 divides by the root of the
    squares' sum plus eps squared, l2hys does so, cuts at 0.2, and again.
    """
    if norm not in HOG_NORMS:
        raise ValueError(f"unknown norm {norm}")
    steps = [(dy, dx) for dy in range(block) for dx in range(block)]
    place = F.explode(F.array(*[F.struct((F.col("cy") - dy).alias("by"), (F.col("cx") - dx).alias("bx"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))
    each = cells.withColumn("p", place).select("img", "p.*", "bin", F.col("weight").alias("value"))
    each = each.where((F.col("by") >= 0) & (F.col("bx") >= 0) & (F.col("by") <= grid[0] - block) & (F.col("bx") <= grid[1] - block))
    key = ["img", "by", "bx"]

    def over(d: DataFrame, total: Column) -> DataFrame:
        return d.join(d.groupBy(*key).agg(total.alias("__t")), key).withColumn("value", F.col("value") / F.col("__t")).drop("__t")

    l1, l2 = F.sum("value") + eps, F.sqrt(F.sum(F.col("value") * F.col("value")) + eps * eps)
    if norm in ("l1", "l1sqrt"):
        each = over(each, l1)
        return each.withColumn("value", F.sqrt("value")) if norm == "l1sqrt" else each
    if norm in ("l2", "l2hys"):
        each = over(each, l2)
    if norm == "l2hys":
        each = over(each.withColumn("value", F.least("value", F.lit(0.2))), l2)
    return each


def hough_lines(mask: DataFrame, angles: int = 180, least: int = 5) -> DataFrame:
    """Votes for lines rho = x cos t + y sin t through set pixels, above ``least``."""
    t = F.explode(F.sequence(F.lit(0), F.lit(angles - 1)))
    v = mask.select("img", "y", "x", t.alias("t"))
    theta = F.radians(F.col("t") * (180.0 / angles))
    rho = F.floor(F.col("x") * F.cos(theta) + F.col("y") * F.sin(theta) + 0.5 + 1e-9).cast("int")
    return v.groupBy("img", rho.alias("rho"), "t").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") > least)


def resize_bilinear(px: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Bilinear scaling in 8.8 fixed point; each output pixel sums four weighted inputs, clamped at the far border."""
    sy, sx = height * 256 // to_height, width * 256 // to_width
    grid = px.select("img").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(to_height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(to_width - 1))))
    fy, fx = F.col("y") * sy, F.col("x") * sx
    y0, x0 = F.shiftright(fy, 8), F.shiftright(fx, 8)
    wy, wx = fy.bitwiseAND(255), fx.bitwiseAND(255)
    corner = lambda dy, dx: F.struct(F.least(y0 + dy, F.lit(height - 1)).alias("sy"), F.least(x0 + dx, F.lit(width - 1)).alias("sx"), ((wy if dy else 256 - wy) * (wx if dx else 256 - wx)).alias("w"))
    need = grid.withColumn("c", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1)))).select("img", "y", "x", "c.*")
    src = px.select("img", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    return need.join(src, ["img", "sy", "sx"], "left").groupBy(*KEY).agg(F.shiftright(F.sum(F.col("w") * F.coalesce("v", F.lit(0))), 16).cast("int").alias("v"))


def warp_affine(px: DataFrame, m: Sequence[float], width: int, height: int, default: int = 0) -> DataFrame:
    """Nearest-pixel inverse warp: the output at p is the input at m p, or ``default`` outside."""
    grid = px.select("img").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    at = grid.withColumn("sx", F.floor(m[0] * F.col("x") + m[1] * F.col("y") + m[2] + 0.5).cast("int")).withColumn("sy", F.floor(m[3] * F.col("x") + m[4] * F.col("y") + m[5] + 0.5).cast("int"))
    src = px.select("img", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    return at.join(src, ["img", "sy", "sx"], "left").select(*KEY, F.coalesce("v", F.lit(default)).alias("v"))


def gaussian_kernel(size: int, sigma: float) -> list[float]:
    """A normalised one-dimensional bell; ``size`` must be odd."""
    if size % 2 == 0:
        raise ValueError("the size must be odd")
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [r / sum(raw) for r in raw]


def separable(px: DataFrame, kernel: Sequence[float], size: tuple[int, int], *, border: str = "zero") -> DataFrame:
    """A kernel along rows, then the same along columns; result s."""
    half = len(kernel) // 2
    rows = correlate(px, [(0, i - half) for i in range(len(kernel))], kernel, size, border=border)
    return correlate(rows, [(i - half, 0) for i in range(len(kernel))], kernel, size, value="s", border=border)


def canny(px: DataFrame, low: float, high: float, size: tuple[int, int], *, of_mean: bool = False) -> DataFrame:
    """Edge pixels: |gx| + |gy| of the Sobel kernel, thinned across the edge, then kept by hysteresis.

    A pixel survives thinning if neither neighbour along its gradient is
    greater; gradients within 22.5 degrees of an axis are compared along it,
    others along the diagonal. With ``of_mean`` the limits are factors of each
    image's mean pixel.
    """
    g = gradients(px, "sobel", size).withColumn("v", F.abs("gx") + F.abs("gy"))

    def work(t: Tile):
        v, gx, gy = t.near(0, 0), t.near(0, 0, "gx"), t.near(0, 0, "gy")
        ax, ay = np.abs(gx), np.abs(gy)
        pair = lambda dy, dx: np.maximum(t.near(dy, dx), t.near(-dy, -dx))
        rival = np.where(ay < ax * _TAN_LOW, pair(0, 1), np.where(ay > ax * _TAN_HIGH, pair(1, 0), np.where((gx > 0) == (gy > 0), pair(1, 1), pair(1, -1))))
        return t.there() & (rival <= v), {"v": v}

    thin = over_tiles(g, 1, work, "v long", ("v", "gx", "gy"))
    if of_mean:
        mean = px.groupBy("img").agg(F.avg("v").alias("mean"))
        limit = thin.join(mean, "img").withColumn("v", F.col("v") / F.greatest("mean", F.lit(1e-9)))
        return regions.hysteresis(limit, low, high)
    return regions.hysteresis(thin, low, high)


def resize_bicubic(px: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Cubic Hermite scaling over 4x4 pixels, clamped at the borders; missing cells are 0, output is cut to 0..255."""
    sy, sx = height / (to_height - 1), width / (to_width - 1)
    grid = px.select("img").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(to_height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(to_width - 1))))
    for c, s in (("y", sy), ("x", sx)):
        grid = grid.withColumn(f"i{c}", ((F.col(c) + 0.5) * s - 0.5).cast("int")).withColumn(f"f{c}", (F.col(c) + 0.5) * s - 0.5 - F.col(f"i{c}"))

    def weight(t: Column, k: int) -> Column:
        return [(-t * t * t + 2 * t * t - t) / 2, (3 * t * t * t - 5 * t * t + 2) / 2, (-3 * t * t * t + 4 * t * t + t) / 2, (t * t * t - t * t) / 2][k]

    at = lambda c, k, most: F.greatest(F.least(F.col(f"i{c}") + (k - 1), F.lit(most - 1)), F.lit(0))
    taps = F.array(*[F.struct(at("y", a, height).alias("sy"), at("x", b, width).alias("sx"), (weight(F.col("fy"), a) * weight(F.col("fx"), b)).alias("w")) for a in range(4) for b in range(4)])
    need = grid.withColumn("c", F.explode(taps)).select(*KEY, "c.*")
    src = px.select("img", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    total = F.round(F.sum(F.col("w") * F.coalesce("v", F.lit(0))), 6)
    return need.join(src, ["img", "sy", "sx"], "left").groupBy(*KEY).agg(F.floor(F.least(F.greatest(total, F.lit(0.0)), F.lit(255.0))).cast("int").alias("v"))


def pyramid(px: DataFrame, width: int, height: int, factor: float = 0.83, levels: int = 8) -> DataFrame:
    """Each level is the original, scaled by a power of ``factor``; level 0 is the original. Columns img, level, y, x, v."""
    out = None
    for n in range(levels):
        w, h = max(1, int(width * factor**n)), max(1, int(height * factor**n))
        level = px if n == 0 else resize_bilinear(px, width, height, w, h)
        level = level.select("img", F.lit(n).alias("level"), "y", "x", "v")
        out = level if out is None else out.unionByName(level)
    return out


def remap_bilinear(px: DataFrame, table: DataFrame, width: int, height: int, to_width: int, to_height: int, default: int = 0) -> DataFrame:
    """Reads each output pixel (y, x) at the place (sy, sx) that a table names; outside, ``default``.

    The table applies to every image; cells it lacks are not put out.
    """
    grid = px.select("img").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(to_height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(to_width - 1))))
    each = grid.join(table.select("y", "x", "sy", "sx"), ["y", "x"])
    inside = (F.col("sy") >= 0) & (F.col("sy") <= height - 1) & (F.col("sx") >= 0) & (F.col("sx") <= width - 1)
    at = each.withColumn("iy", F.floor("sy").cast("int")).withColumn("ix", F.floor("sx").cast("int")).withColumn("inside", inside)
    fy, fx = F.col("sy") - F.col("iy"), F.col("sx") - F.col("ix")
    corner = lambda a, b: F.struct(F.least(F.col("iy") + a, F.lit(height - 1)).alias("cy"), F.least(F.col("ix") + b, F.lit(width - 1)).alias("cx"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("w"))
    need = at.withColumn("c", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)]))).select(*KEY, "inside", "c.*")
    src = px.select("img", F.col("y").alias("cy"), F.col("x").alias("cx"), "v")
    sums = need.join(src, ["img", "cy", "cx"], "left").groupBy(*KEY).agg(F.first("inside").alias("inside"), F.sum(F.col("w") * F.coalesce("v", F.lit(0))).alias("s"))
    return sums.select(*KEY, F.when(F.col("inside"), F.floor(F.round("s", 6)).cast("int")).otherwise(default).alias("v"))


def remap_nearest(px: DataFrame, table: DataFrame, size: tuple[int, int], to_size: tuple[int, int], default: int = 0) -> DataFrame:
    """Reads each output pixel (y, x) at the pixel nearest to the place (sy, sx) that a table names; outside, ``default``."""
    near = lambda c: F.floor(F.when(F.abs(c) < 1e9, F.col(c)).otherwise(-1.0) + 0.5).cast("int")
    grid = px.select("img").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(to_size[0] - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(to_size[1] - 1))))
    each = grid.join(table.select("y", "x", near("sy").alias("sy"), near("sx").alias("sx")), ["y", "x"])
    src = px.where(F.col("y").between(0, size[0] - 1) & F.col("x").between(0, size[1] - 1)).select("img", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    return each.join(src, ["img", "sy", "sx"], "left").select(*KEY, F.coalesce("v", F.lit(default)).alias("v"))


def warp_table(spark, m: Sequence[float], to_size: tuple[int, int], inverse: bool = True) -> DataFrame:
    """Where each pixel of the output is read, for a 2x3 or 3x3 matrix row by row: at m p, or with ``inverse=False`` at the place that m takes to p."""
    a = np.array([*m, 0, 0, 1] if len(m) == 6 else m, float).reshape(3, 3)
    a = (a if inverse else np.linalg.inv(a)).ravel().tolist()
    grid = spark.range(to_size[0] * to_size[1]).select(F.floor(F.col("id") / to_size[1]).cast("int").alias("y"), (F.col("id") % to_size[1]).cast("int").alias("x"))
    sx, sy = pixel.perspective(a, F.col("x"), F.col("y"))
    return grid.select("y", "x", sy.alias("sy"), sx.alias("sx"))


def warp(px: DataFrame, m: Sequence[float], size: tuple[int, int], to_size: tuple[int, int], *, mode: str = "bilinear", inverse: bool = True, default: int = 0) -> DataFrame:
    """An image through a 2x3 or 3x3 matrix, "nearest" or "bilinear"."""
    if mode not in ("nearest", "bilinear"):
        raise ValueError(f"unknown mode {mode}")
    table = warp_table(px.sparkSession, m, to_size, inverse)
    return remap_nearest(px, table, size, to_size, default) if mode == "nearest" else remap_bilinear(px, table, size[1], size[0], to_size[1], to_size[0], default)


def patch_orientation(px: DataFrame, diameter: int) -> DataFrame:
    """First moments (m10, m01) of the disc around each pixel and the direction of their sum, in degrees [0, 360)."""
    r = diameter // 2
    disc = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]

    def work(t: Tile):
        return t.there(), {"m10": sum(t.near(dy, dx) * dx for dy, dx in disc), "m01": sum(t.near(dy, dx) * dy for dy, dx in disc)}

    m = over_tiles(px, r, work, "m10 long, m01 long")
    return m.withColumn("angle", pixel.degrees_of(F.col("m01").cast("double"), F.col("m10").cast("double")))


def hough_peaks(votes: DataFrame, most: int) -> DataFrame:
    """Lines with no greater neighbour in (rho, t); of each image's, the ``most`` strongest, ties to smaller rho, then t."""
    p = votes.select("img", F.col("rho").alias("y"), F.col("t").alias("x"), F.col("votes").alias("v"))
    n = over_tiles(p, 1, lambda t: (t.there() & (np.maximum.reduce([t.near(*o) for o in NINE]) == t.near(0, 0)), {"votes": t.near(0, 0)}), "votes long")
    rank = F.row_number().over(Window.partitionBy("img").orderBy(F.desc("votes"), "y", "x"))
    return n.withColumn("rank", rank).where(F.col("rank") <= most).select("img", F.col("y").alias("rho"), F.col("x").alias("t"), "votes")


def to_segments(lines: DataFrame, width: int, height: int, angles: int = 180) -> DataFrame:
    """Polar lines (rho, t) as end points over the image's width; upright lines (t = 0) run from top to bottom."""
    theta = F.radians(F.col("t") * (180.0 / angles))
    y = lambda x: (F.col("rho") - x * F.cos(theta)) / F.sin(theta)
    up, rho = F.col("t") == 0, F.col("rho").cast("double")
    pick = lambda a, b, name: F.when(up, a).otherwise(b).alias(name)
    return lines.select(*lines.columns, pick(rho, F.lit(0.0), "x0"), pick(F.lit(0.0), y(0.0), "y0"), pick(rho, F.lit(float(width)), "x1"), pick(F.lit(float(height)), y(float(width)), "y1"))
