"""Queries over closed-form inputs: frames of every pixel format, byte descriptors, and statistics with known sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import pixel as P
from tessella.operators import aggregates as A
from tessella.operators import matching as M
from tessella.plans.catalogue import register
from tessella.sources import formats

#: Height and width of closed-form frames, odd and even.
FRAME = (18, 27)
IMAGES = 5
#: Bytes of frames that a task makes: each task of a conversion holds a Python worker a step, so few small frames share one.
TASK_BYTES = 1 << 22


def frames(spark: SparkSession, fmt: str, size: tuple[int, int] = FRAME, images: int = IMAGES) -> DataFrame:
    """Frames whose channels are linear in place and image, modulo 256."""
    h, w = size

    def work(batches):
        empty = formats.unpack(bytes(formats.frame_bytes(fmt, h, w)), fmt, h, w)
        for batch in batches:
            out = []
            for img in batch.column(0).to_pylist():
                channels = {}
                for c, a in empty.items():
                    y, x = np.indices(a.shape)
                    ky, kx, ki = _LINEAR[_AS.get(c, c)]
                    channels[c] = (x * kx + y * ky + img * ki) % 256
                out.append(formats.pack(channels, fmt))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["img", "content"])

    tasks = max(1, min(images, -(-images * formats.frame_bytes(fmt, h, w) // TASK_BYTES)))
    return spark.range(0, images, 1, tasks).select(F.col("id").cast("int").alias("img")).mapInArrow(work, "img int, content binary")


#: Which of four linear rules a channel follows, and the rules' factors of y, x and the image.
_AS = {"r": "y", "g": "u", "b": "v", "h": "y", "s": "u"}
_LINEAR = {"y": (13, 7, 29), "u": (5, 11, 3), "v": (17, 3, 31), "a": (1, 1, 1)}


def _place(c: str, y: str, x: str) -> str:
    ky, kx, ki = _LINEAR[c]
    return f"(({x}) * {kx} + ({y}) * {ky} + img * {ki}) % 256"


def _grid_sql(fmt: str) -> str:
    """Channels a, b, c of every pixel as the format keeps them: chroma shared, 5 and 6 bits widened."""
    sy, sx = formats._steps(fmt)
    a, b, c = _place("y", "y", "x"), _place("u", f"y // {sy}", f"x // {sx}"), _place("v", f"y // {sy}", f"x // {sx}")
    if fmt in formats.SHORT:
        five = lambda e: f"((({e}) >> 3 << 3) | (({e}) >> 5))"
        a, b, c = five(a), f"((({b}) >> 2 << 2) | (({b}) >> 6))", five(c)
    return f"""WITH p AS (SELECT CAST(i AS INT) AS img, CAST(yy AS INT) AS y, CAST(xx AS INT) AS x FROM (SELECT unnest(range(0, {IMAGES})) AS i), (SELECT unnest(range(0, {FRAME[0]})) AS yy), (SELECT unnest(range(0, {FRAME[1]})) AS xx)),
s AS (SELECT img, y, x, {a} AS a, {b} AS b, {c} AS c FROM p)"""


_CUT = "CAST(least(greatest({}, 0), 255) AS INT)"
_TO_YUV = {"y": _CUT.format("((33 * a + 65 * b + 13 * c) >> 7) + 16"), "u": _CUT.format("((-38 * a - 74 * b + 112 * c) >> 8) + 128"), "v": _CUT.format("((112 * a - 94 * b - 18 * c) >> 8) + 128")}
_TO_RGB = {"r": _CUT.format("(37 * (a - 16) + 51 * (c - 127)) >> 5"), "g": _CUT.format("(37 * (a - 16) - 13 * (b - 127) - 26 * (c - 127)) >> 5"), "b": _CUT.format("(37 * (a - 16) + 65 * (b - 127)) >> 5")}


def _long_sql(fmt: str, channels: dict[str, str]) -> str:
    return _grid_sql(fmt) + " " + " UNION ALL ".join(f"SELECT img, '{c}' AS c, y, x, {e} AS v FROM s" for c, e in channels.items())


def _converted(src: str, dst: str, sql: str) -> None:
    def f(spark, sf_dir):
        return formats.split(formats.convert(frames(spark, src), src, dst, FRAME), dst, FRAME)

    f.__name__ = f"convert_{src}_{dst}"
    register(sql)(f)


_RGB_FORMATS = [f for f in formats.FORMATS if f in formats.SHORT or "r" in formats.PACKED.get(f, "")]
_YUV_FORMATS = [*formats.PLANAR, *formats.SEMI, *formats.PAIRED]
for _fmt in _RGB_FORMATS:
    _converted(_fmt, "yuv444p", _long_sql(_fmt, _TO_YUV))
    _converted(_fmt, "y", _long_sql(_fmt, {"y": _TO_YUV["y"]}))
for _fmt in _YUV_FORMATS:
    _converted(_fmt, "rgb24", _long_sql(_fmt, _TO_RGB))
    _converted(_fmt, "y", _long_sql(_fmt, {"y": "CAST(a AS INT)"}))
for _fmt in ("bgr24", "rgba32", "bgra32"):
    _converted("nv12", _fmt, _long_sql("nv12", _TO_RGB | ({"a": "255"} if "a" in formats.PACKED[_fmt] else {})))
_converted("y", "rgb24", _long_sql("y", dict.fromkeys("rgb", "CAST(a AS INT)")))


def _repacked(fmt: str) -> None:
    """Channels out of a frame, and back into one: the same bytes, so the same channels as the closed form."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = frames(spark, fmt)
        back = formats.merge(formats.split(given, fmt, FRAME), fmt, FRAME)
        return back.select("img", F.md5("content").alias("md5"), F.length("content").cast("int").alias("n"))

    f.__name__ = f"repack_{fmt}"
    register(_repack_sql(fmt))(f)


def _repack_sql(fmt: str) -> str:
    """The bytes of each frame in order, as hexadecimal digits, hashed."""
    h, w = FRAME
    sy, sx = formats._steps(fmt)
    ch, cw = -(-h // sy), -(-w // sx)
    cell = lambda c, y, x: _place(_AS.get(c, c), y, x)
    parts = []  # (order of the part, rows, columns, order inside a cell, value)
    if fmt in formats.PACKED:
        parts = [(0, h, w, i, cell(c, "y", "x")) for i, c in enumerate(formats.PACKED[fmt])]
    elif fmt in formats.SHORT:
        order, bytes_ = formats.SHORT[fmt]
        k = f"((({cell(order[0], 'y', 'x')}) >> 3 << 11) | (({cell(order[1], 'y', 'x')}) >> 2 << 5) | (({cell(order[2], 'y', 'x')}) >> 3))"
        low, high = f"({k} & 255)", f"({k} >> 8)"
        parts = [(0, h, w, i, e) for i, e in enumerate((low, high) if bytes_[0] == "<" else (high, low))]
    elif fmt in formats.PLANAR:
        parts = [(i, *((h, w) if c == "y" else (ch, cw)), 0, cell(c, "y", "x")) for i, c in enumerate(formats.PLANAR[fmt][0])]
    elif fmt in formats.SEMI:
        parts = [(0, h, w, 0, cell("y", "y", "x"))] + [(1, ch, cw, i, cell(c, "y", "x")) for i, c in enumerate(formats.SEMI[fmt])]
    else:
        seen = 0
        for i, c in enumerate(formats.PAIRED[fmt]):
            at = f"least(2 * x + {seen}, {w - 1})" if c == "y" else "x"
            seen += c == "y"
            parts.append((0, h, cw, i, cell(c, "y", at)))
    rows = " UNION ALL ".join(f"SELECT img, {p} AS p, y, x, {o} AS o, {e} AS v FROM (SELECT unnest(range(0, {IMAGES})) AS img), (SELECT unnest(range(0, {r})) AS y), (SELECT unnest(range(0, {n})) AS x)" for p, r, n, o, e in parts)
    return f"WITH b AS ({rows}) SELECT CAST(img AS INT) AS img, md5(unhex(string_agg(lpad(lower(to_hex(v)), 2, '0'), '' ORDER BY p, y, x, o))) AS md5, CAST(count(*) AS INT) AS n FROM b GROUP BY 1"


for _fmt in formats.FORMATS:
    if _fmt != "hsv":
        _repacked(_fmt)


# byte descriptors

def described(spark: SparkSession, rows: int, width: int, train: bool) -> DataFrame:
    """Byte descriptors (vec_id, e): byte i of row j is i + width j, or of a query 2 (i + j) + 1, modulo 256."""

    def work(batches):
        for batch in batches:
            j = batch.column(0).to_numpy()[:, None]
            i = np.arange(width)[None, :]
            raw = (i + width * j if train else 2 * (i + j) + 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in raw], pa.binary())], ["vec_id", "e"])

    return spark.range(rows).select(F.col("id").alias("vec_id")).mapInArrow(work, "vec_id long, e binary")


def _bytes_sql(width: int, rows: int, query: str) -> str:
    return f"""WITH t AS (SELECT unnest(range(0, {rows})) AS t), i AS (SELECT unnest(range(0, {width})) AS i), q AS ({query}),
d AS (SELECT q, t, sum(bit_count(CAST(xor((i + {width} * t) % 256, (2 * (i + q) + 1) % 256) AS INTEGER))) AS d FROM q, t, i GROUP BY 1, 2)"""


@register(_bytes_sql(32, 725, "SELECT 0 AS q") + " SELECT t AS vec_id, CAST(d AS INT) AS distance FROM d")
def golden_hamming(spark, sf_dir):
    patch = F.lit(bytes((2 * i + 1) & 255 for i in range(32)))
    return described(spark, 725, 32, True).select("vec_id", M.hamming_bytes(F.col("e"), patch, 32).cast("int").alias("distance"))


@register(_bytes_sql(32, 715, "SELECT unnest(range(0, 715)) AS q") + """, r AS (SELECT q AS query_id, t AS vec_id, CAST(d AS INT) AS distance, CAST(row_number() OVER (PARTITION BY q ORDER BY d, t) AS INT) AS rank FROM d)
SELECT * FROM r WHERE rank <= 2""")
def golden_brute_force(spark, sf_dir):
    return M.nearest(described(spark, 715, 32, True), described(spark, 715, 32, False), 2, "hamming", own=True)


# statistics

_N = 2015
_XY = "(CASE WHEN i % 2 = 1 THEN i ELSE -0.7::DOUBLE * i END) + 0.5::DOUBLE AS x, 0.2::DOUBLE * i + i + 0.7::DOUBLE AS y"
_SETS = f"WITH p AS (SELECT n AS set_id, i, {_XY} FROM (VALUES (4), ({_N})) AS t(n), (SELECT unnest(range(0, {_N})) AS i) WHERE i < n)"


def _sets(spark: SparkSession) -> DataFrame:
    """The first 4 and the first 2,015 points of one sequence, as two sets."""
    i = F.col("i")
    p = spark.range(_N).select(F.col("id").alias("i"), F.explode(F.array(F.lit(4), F.lit(_N))).alias("set_id")).where("i < set_id")
    return p.select("set_id", "i", (F.when(i % 2 == 1, i).otherwise(i * -0.7) + 0.5).alias("x"), (i * 0.2 + i + 0.7).alias("y"))


@register(f"{_SETS}, c AS (SELECT set_id, avg(x) AS tx, avg(y) AS ty FROM p GROUP BY 1) SELECT set_id, round(any_value(tx), 6) AS tx, round(any_value(ty), 6) AS ty, round(sqrt(2) / avg(sqrt(pow(x - tx, 2) + pow(y - ty, 2))), 6) AS s FROM p JOIN c USING (set_id) GROUP BY 1")
def golden_hartley(spark, sf_dir):
    return A.hartley(_sets(spark), "set_id").select("set_id", *[F.round(c, 6).alias(c) for c in ("tx", "ty", "s")])


@register(f"{_SETS} SELECT set_id, round(sum(pow(x - 1234569.156325::DOUBLE, 2)) / (count(*) - 1) / 1e6, 3) AS variance FROM p GROUP BY 1")
def golden_variance(spark, sf_dir):
    return _sets(spark).groupBy("set_id").agg(F.round(A.variance_about(F.col("x"), 1234569.156325) / 1e6, 3).alias("variance"))


@register(f"{_SETS}, h AS (SELECT *, 0.3::DOUBLE * i + i + 0.4::DOUBLE AS z, (CASE WHEN i % 2 = 1 THEN i ELSE -0.3::DOUBLE * i END) + 5 AS bx, (CASE WHEN i % 2 = 1 THEN i ELSE -0.8::DOUBLE * i END) + 7.8::DOUBLE AS by_ FROM p) SELECT set_id, round(sum(pow(x / z - bx, 2) + pow(y / z - by_, 2)), 4) AS total FROM h GROUP BY 1")
def golden_errors(spark, sf_dir):
    i = F.col("i")
    px, py = P.cartesian(F.col("x"), F.col("y"), i * 0.3 + i + 0.4)
    bx, by = F.when(i % 2 == 1, i).otherwise(i * -0.3) + 5, F.when(i % 2 == 1, i).otherwise(i * -0.8) + 7.8
    return _sets(spark).groupBy("set_id").agg(F.round(F.sum((px - bx) ** 2 + (py - by) ** 2), 4).alias("total"))

