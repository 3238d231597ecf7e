"""Column expressions for single values: arithmetic, bits, colour, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(v: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def add_saturated(a: Column, b: Column, most: int = 255) -> Column:
    return F.least(a + b, F.lit(most))


def sub_saturated(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def round_away(x: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(-F.floor(0.5 - x)).cast("long")


def gamma(v: Column, g: float) -> Column:
    return round_away(F.pow(v / 255.0, F.lit(g)) * 255.0)


def outside(v: Column, low: int, high: int) -> Column:
    """255 where the value is not in [low, high]."""
    return F.when(v.between(low, high), 0).otherwise(255)


def degrees_of(y: Column, x: Column) -> Column:
    """Direction in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def saturated(v: Column, low: int, high: int) -> Column:
    """A number cut to whole numbers of a range, towards zero."""
    return F.least(F.greatest(F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)), F.lit(low)), F.lit(high))


# fixed values: integer colour transforms
def rgb_to_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    y = F.shiftright(33 * r + 65 * g + 13 * b, 7) + 16
    u = F.shiftright(-38 * r - 74 * g + 112 * b, 8) + 128
    v = F.shiftright(112 * r - 94 * g - 18 * b, 8) + 128
    return tuple(clip(c, 0, 255) for c in (y, u, v))


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Chroma is centred at 127, luma at 16."""
    y, u, v = y - 16, u - 127, v - 127
    r = F.shiftright(37 * y + 51 * v, 5)
    g = F.shiftright(37 * y - 13 * u - 26 * v, 5)
    b = F.shiftright(37 * y + 65 * u, 5)
    return tuple(clip(c, 0, 255) for c in (r, g, b))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit hue with 43 for a sixth of a turn, saturation and value.

    Quotients are single-precision products with a rounded reciprocal, rounded
    to the nearest integer, halves away from zero; the hue wraps at 256.
    """
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low

    def scaled(a: Column, full: float, by: Column) -> Column:
        step = F.lit(full).cast("float") * F.try_divide(F.lit(1.0), by.cast("double")).cast("float")
        return round_away(F.coalesce(a.cast("float") * step, F.lit(0.0).cast("float")).cast("double")).cast("int")

    # fixed values: a sixth of a turn is 43, a third 85, two thirds 171
    h = F.when(top == r, scaled(g - b, 43.0, span)).when(top == g, 85 + scaled(b - r, 43.0, span)).otherwise(171 + scaled(r - g, 43.0, span))
    return F.pmod(h, F.lit(256)), scaled(span, 255.0, top), top


def to_565(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(F.shiftright(r, 3), 11).bitwiseOR(F.shiftleft(F.shiftright(g, 2), 5)).bitwiseOR(F.shiftright(b, 3))


def from_565(p: Column) -> tuple[Column, Column, Column]:
    """Channels widened by repeating their high bits."""
    r, g, b = F.shiftright(p, 11).bitwiseAND(31), F.shiftright(p, 5).bitwiseAND(63), p.bitwiseAND(31)
    five = lambda c: F.shiftleft(c, 3).bitwiseOR(F.shiftright(c, 2))
    return five(r), F.shiftleft(g, 2).bitwiseOR(F.shiftright(g, 4)), five(b)


def cartesian(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Homogeneous coordinates as a point; at z = 0 infinite, as division of doubles has it (0 / 0: not a number)."""

    def over(a: Column) -> Column:
        a, d = a.cast("double"), z.cast("double")
        far = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
        return F.when(d == 0, far).otherwise(F.try_divide(a, d))

    return over(x), over(y)


def perspective(m: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    """A 3x3 matrix, row by row, applied to a point; infinite where the third coordinate is 0."""
    return cartesian(m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5], m[6] * x + m[7] * y + m[8])


def line_distance(a: float, b: float, c: float, x: Column, y: Column) -> Column:
    if a == 0 and b == 0:
        raise ValueError("not a line")
    return F.abs(a * x + b * y + c) / float((a * a + b * b) ** 0.5)


def parabola_distance(a: float, b: float, c: float, x: Column, y: Column, sideways: bool = False) -> Column:
    x, y = (y, x) if sideways else (x, y)
    return F.abs(a * x * x + b * x + c - y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, p: s + p)


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, p: s + p)


def _with(a: Column, value: Column, f) -> Column:
    """``f`` of each component and one value, which is computed once for the vector, not for each component."""
    return F.zip_with(a, F.array_repeat(value, F.size(a)), f)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(a: Column) -> Column:
    """Differences to the largest component are clipped to [-86, 0]."""
    e = _with(a, F.array_max(a), lambda x, top: F.exp(F.greatest(x - top, F.lit(-86.0))))
    return _with(e, _total(e), lambda x, total: x / total)


def unit_l2(a: Column) -> Column:
    """A vector over its length; null components where the length is 0."""
    return _with(a, F.sqrt(dot(a, a)), lambda x, n: F.try_divide(x, n))


def unit_range(a: Column) -> Column:
    """Components moved and scaled to [0, 1]; null where all are equal."""
    moved = _with(a, F.array_min(a), lambda x, low: x - low)
    return _with(moved, F.array_max(a) - F.array_min(a), lambda x, span: F.try_divide(x, span))


def z_scores(a: Column, eps: float = 1e-9) -> Column:
    """Components less their mean, over the sample deviation plus ``eps``."""
    moved = _with(a, _total(a) / F.size(a), lambda x, mean: x - mean)
    return _with(moved, F.sqrt(F.try_divide(dot(moved, moved), F.size(a) - 1)), lambda x, spread: x / (spread + eps))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """8-bit hue (43 for a sixth of a turn), saturation and value back to channels; products are shifted, not divided."""
    part = F.floor(h / 43).cast("int")
    rest = (h - part * 43) * 6
    p = F.shiftright(v * (255 - s), 8)
    q = F.shiftright(v * (255 - F.shiftright(s * rest, 8)), 8)
    t = F.shiftright(v * (255 - F.shiftright(s * (255 - rest), 8)), 8)
    pick = lambda *six: F.when(s == 0, v).otherwise(F.get(F.array(*six), F.least(part, F.lit(5))))
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)
