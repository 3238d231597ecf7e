"""Operators without an SQL oracle, against closed forms, planted outliers and NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.functions import pixel
from tessella.operators import camera, neighbourhood, spectral
from tessella.sources import images


def test_singular_values_of_known_matrices(spark):
    for rows, cols, total in ((11, 7, 99.924535944946882), (9, 9, 95.805939771678538), (3, 3, 9.2927635378145208)):
        cells = [(1, j, i, (i if i % 2 else -i) + 0.5 * j + j + 0.7) for j in range(rows) for i in range(cols)]
        got = spectral.singular_values(spark.createDataFrame(cells, "img int, i int, j int, v double"), "img")
        assert got.agg(F.sum("value")).first()[0] == pytest.approx(total, abs=1e-4)


def test_principal_components(spark):
    a = np.random.default_rng(1).normal(size=(60, 5)) * [5, 3, 2, 1, 0.5]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "vec_id long, e array<double>")
    c = spectral.principal_components(v, 5, 3).orderBy("k")
    got = c.collect()
    values, vectors = np.linalg.eigh(np.cov(a.T))
    assert [r["value"] for r in got] == pytest.approx(values[::-1][:3].tolist())
    for r, want in zip(got, vectors.T[::-1], strict=False):
        assert abs(float(np.dot(r["vector"], want))) == pytest.approx(1.0)
    p = np.array([r["p"] for r in spectral.project_components(v, c, 5).orderBy("vec_id").collect()])
    assert np.allclose(p, (a - a.mean(axis=0)) @ np.array([r["vector"] for r in got]).T)


def test_homography_of_few_and_odd_rows(spark):
    m = [1.5, 0.2, -4.0, -0.1, 0.8, 6.0, 0.001, -0.002, 1.0]
    pts = [("a", float(x), float(y)) for x in range(0, 50, 9) for y in range(0, 40, 7)] + [("few", 1.0, 2.0), ("few", 3.0, 5.0), ("one", 2.0, 2.0), (None, None, 1.0)]
    df = spark.createDataFrame(pts, "k string, x double, y double")
    u, v = pixel.perspective(m, F.col("x"), F.col("y"))
    got = camera.homography(df.withColumn("u", u).withColumn("v", v), "k").collect()
    assert [r["k"] for r in got] == ["a"]
    assert got[0]["h"] == pytest.approx(m, abs=1e-6)
    assert camera.homography(df.where("false").withColumn("u", u).withColumn("v", v), "k").count() == 0


def test_robust_line_ignores_outliers(spark):
    rng = np.random.default_rng(3)
    near = [("s", x, 0.5 * x + 2 + e) for x, e in zip(np.linspace(0, 100, 80).tolist(), rng.normal(0, 0.05, 80).tolist(), strict=True)]
    far = [("s", x, y) for x, y in rng.uniform(0, 100, (25, 2)).tolist() if abs(y - 0.5 * x - 2) > 5]
    df = spark.createDataFrame([*near, *far, ("s", None, 1.0)], "k string, x double, y double")
    r = camera.fit_line_robust(df, "k", within=0.5).first()
    assert r["n"] == 80 and r["angle"] == pytest.approx(math.atan(0.5), abs=1e-3)
    assert camera.fit_line_robust(df.where("false"), "k", within=0.5).count() == 0


def test_zero_rotation_is_identity(spark):
    m = camera.rotation_matrix(*[F.lit(0.0)] * 3)
    r = spark.range(1).select(*[c.alias(f"m{i}") for i, c in enumerate(m)]).first()
    assert list(r) == [1, 0, 0, 0, 1, 0, 0, 0, 1]


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_image_files(channels):
    a = np.random.default_rng(channels).integers(0, 256, (7, 5, channels)).astype(np.uint8)
    assert (images.decode_png(images.encode_png(a)) == a).all()
    back = images.decode_bmp(images.encode_bmp(a))
    assert (back == (np.repeat(a, 3, axis=2) if channels == 1 else a)).all()


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    """Lines filtered by the rules of the format come back."""
    import struct
    import zlib

    a = np.random.default_rng(kind).integers(0, 256, (6, 4, 3)).astype(np.uint8)
    flat = a.reshape(6, 12).astype(int)
    body = b""
    for y in range(6):
        line = []
        for i in range(12):
            left = flat[y, i - 3] if i >= 3 else 0
            up = flat[y - 1, i] if y else 0
            corner = flat[y - 1, i - 3] if y and i >= 3 else 0
            guess = [0, left, up, (left + up) // 2, min((left, up, corner), key=lambda k: abs(left + up - corner - k))][kind]
            line.append((flat[y, i] - guess) % 256)
        body += bytes([kind, *line])
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 4, 6, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")
    assert (images.decode_png(raw) == a).all()
    with pytest.raises(ValueError):
        images.decode_png(raw[:40] + bytes([raw[40] ^ 1]) + raw[41:])


def test_pyramid_sizes(spark):
    px = spark.range(64).select(F.lit(1).alias("img"), F.floor(F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), F.lit(9).alias("v"))
    got = {r["level"]: (r["n"], r["low"], r["high"]) for r in neighbourhood.pyramid(px, 8, 8, 0.5, 3).groupBy("level").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    assert got == {0: (64, 9, 9), 1: (16, 9, 9), 2: (4, 9, 9)}


def test_hue_and_saturation_are_rounded(spark):
    df = spark.createDataFrame([(0, 0, 0), (90, 30, 10), (10, 90, 29), (29, 10, 90), (90, 10, 30), (7, 7, 7)], "r int, g int, b int")
    h, s, v = pixel.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    got = [tuple(r) for r in df.select(h, s, v).collect()]
    assert got == [(0, 0, 0), (11, 227, 90), (95, 227, 90), (181, 227, 90), (245, 227, 90), (0, 0, 7)]
