"""Models through points of which a third are wrong."""

import numpy as np
from tessella.functions.pixel import cartesian
from tessella.operators import camera, matching, robust, spectral
from tessella.plans import golden
from pyspark.sql import functions as F


def test_homography_with_wrong_pairs(spark):
    r = np.random.default_rng(3)
    h = np.array([[1.2, 0.1, 5.0], [-0.05, 0.9, -3.0], [1e-4, 2e-4, 1.0]])
    rows = []
    for s in ("a", "b"):
        p = r.uniform(0, 400, (300, 2))
        q = np.column_stack([p, np.ones(300)]) @ h.T
        q = q[:, :2] / q[:, 2:]
        q[:100] += r.uniform(20, 200, (100, 2))
        rows += [(s, *map(float, (*a, *b))) for a, b in zip(p, q, strict=True)]
    pairs = spark.createDataFrame(rows, "set_id string, x double, y double, u double, v double").repartition(5)
    got = {x.set_id: x for x in camera.homography_robust(pairs, "set_id", 0.5).collect()}
    assert set(got) == {"a", "b"} and all(x.n == 200 for x in got.values())
    assert all(np.allclose(np.array(x.h).reshape(3, 3), h, rtol=1e-6, atol=1e-8) for x in got.values())
    again = {x.set_id: x.h for x in camera.homography_robust(pairs.repartition(2), "set_id", 0.5).collect()}
    assert all(np.allclose(again[s], got[s].h) for s in got)


def test_parabola_and_line_with_wrong_points(spark):
    r = np.random.default_rng(4)
    x = np.arange(90.0)
    y = 0.5 * x * x - 3 * x + 7
    y[::3] += r.uniform(50, 500, 30)
    rows = [("p", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("few", 1.0, 2.0), ("few", None, 2.0)]
    points = spark.createDataFrame(rows, "set_id string, x double, y double")
    got = camera.fit_parabola_robust(points, "set_id", 1.0).collect()
    assert [(g.set_id, g.n, round(g.a, 6), round(g.b, 6), round(g.c, 6)) for g in got] == [("p", 60, 0.5, -3.0, 7.0)]
    line = spark.createDataFrame([("l", float(i), 2.0 * i + 1 if i % 3 else 100.0 + i * i) for i in range(60)], "set_id string, x double, y double")
    agree = robust.consensus(line, "set_id", ["x", "y"], 2, robust.line_through, robust.line_residual, 0.1)
    assert sorted(int(r.x) for r in agree.collect()) == [i for i in range(60) if i % 3]


def test_points_at_infinity(spark):
    df = spark.createDataFrame([(1.0, -2.0, 0.0), (0.0, 4.0, 2.0)], "x double, y double, z double")
    a, b = cartesian(F.col("x"), F.col("y"), F.col("z"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [(float("inf"), float("-inf")), (0.0, 2.0)]


def test_sums_of_byte_matches(spark):
    for width, rows, first, second in ((200, 258, 198706, 198706), (32, 715, 77143, 77143), (2005, 101, 807107, 807237)):
        got = matching.nearest(golden.described(spark, rows, width, True), golden.described(spark, rows, width, False), 2, "hamming", own=True, wave=300)
        sums = {r["rank"]: r.d for r in got.groupBy("rank").agg(F.sum("distance").alias("d")).collect()}
        assert sums == {1: first, 2: second}


def test_sums_of_byte_distances(spark):
    for width, rows, total in ((2005, 101, 809911), (32, 725, 92736)):
        patch = F.lit(bytes((2 * i + 1) & 255 for i in range(width)))
        assert golden.described(spark, rows, width, True).agg(F.sum(matching.hamming_bytes(F.col("e"), patch, width))).first()[0] == total


def test_nearest_has_no_pairs_in_its_plan(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "vec_id long, e array<double>")
    plan = matching.nearest(df, df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_golden_singular_values(spark):
    total = {(11, 7): 99.924535944946882, (9, 9): 95.805939771678538, (3, 3): 9.2927635378145208}
    cells = [(f"{h}x{w}", j, i, (i if i % 2 else -i) + 0.5 * j + j + 0.7) for h, w in total for j in range(h) for i in range(w)]
    got = spectral.singular_values(spark.createDataFrame(cells, "m string, i int, j int, v double"), "m")
    sums = {}
    for r in got.collect():
        sums[r.m] = sums.get(r.m, 0.0) + r.value
    # values that are 0 come out as the square root of rounding
    assert all(abs(sums[f"{h}x{w}"] - t) < 1e-5 for (h, w), t in total.items())
