"""Registered queries over the derived fixtures, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import pixel as P
from tessella.operators import aggregates as A
from tessella.operators import camera as C
from tessella.operators import matching as M
from tessella.operators import neighbourhood as N
from tessella.operators import regions as R
from tessella.operators import spectral as S
from tessella.sources import fixtures as X
from tessella.sources import images, matrices

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PX = f"WITH {X.RASTER_SQL}"
VEC = f"WITH {X.VECTORS_SQL}"
PT = f"WITH {X.POINTS_SQL}"
RGB = f"WITH {X.COLOURS_SQL}"
SIZE = (X.SIDE, X.SIDE)
#: Cells of rasters, and where a 3x3 kernel stays inside the image.
IN3 = "(a.y BETWEEN 1 AND 30 AND a.x BETWEEN 1 AND 30)"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    """Rounded for comparison; negative zero becomes zero."""
    return F.round(c, 6) + F.lit(0.0)


def two_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = X.raster(spark, sf_dir)
    a = px.where("img % 2 = 1").withColumnRenamed("v", "a")
    b = px.where("img % 2 = 0").select((F.col("img") - 1).alias("img"), "y", "x", F.col("v").alias("b"))
    return a.join(b, ["img", "y", "x"])


TWO = f"""{PX}, two AS (SELECT a.img, a.y, a.x, a.v AS a, b.v AS b FROM raster a JOIN raster b
  ON a.img % 2 = 1 AND b.img = a.img + 1 AND a.y = b.y AND a.x = b.x)"""


# single values

@register(f"""{TWO} SELECT img, y, x, a + b AS add_, a - b AS sub_, (a - 3) * 2 AS submul, least(a + b, 255) AS adds, greatest(a - b, 0) AS subs,
  a * 3 AS scaled, least(greatest(a, 20), 200) AS clipped, greatest(a, b) AS larger, abs(a) + abs(b) AS sum_abs FROM two""")
def pixel_arithmetic(spark, sf_dir):
    t, a, b = two_rasters(spark, sf_dir), F.col("a"), F.col("b")
    return t.select("img", "y", "x", (a + b).alias("add_"), (a - b).alias("sub_"), ((a - 3) * 2).alias("submul"), P.add_saturated(a, b).alias("adds"), P.sub_saturated(a, b).alias("subs"), (a * 3).alias("scaled"), P.clip(a, 20, 200).alias("clipped"), F.greatest(a, b).alias("larger"), (F.abs(a) + F.abs(b)).alias("sum_abs"))


@register(f"{TWO} SELECT img, y, x, a & b AS and_, a | b AS or_, xor(a, b) AS xor_, b & (255 - a) AS and_not, 255 - a AS not_, CASE WHEN a >= 50 AND a <= 100 THEN 0 ELSE 255 END AS clip_not, CAST(bit_count(xor(a, b)) AS INT) AS hamming FROM two")
def pixel_bits(spark, sf_dir):
    t, a, b = two_rasters(spark, sf_dir), F.col("a"), F.col("b")
    flip = F.bitwise_not(a).bitwiseAND(255)
    return t.select("img", "y", "x", a.bitwiseAND(b).alias("and_"), a.bitwiseOR(b).alias("or_"), a.bitwiseXOR(b).alias("xor_"), flip.bitwiseAND(b).alias("and_not"), flip.alias("not_"), P.outside(a, 50, 100).alias("clip_not"), M.hamming(a, b).alias("hamming"))


@register(f"{PX} SELECT img, y, x, xor(v, coalesce((SELECT b.v FROM raster b WHERE b.img = a.img AND b.x = a.x AND b.y = a.y - 1), 0)) AS v FROM raster a")
def xor_vertical(spark, sf_dir):
    return N.xor_above(X.raster(spark, sf_dir))


@register(f"{PX} SELECT img, y, x, CAST(floor(pow(v / 255.0::DOUBLE, 2.2) * 255 + 0.5) AS BIGINT) AS v FROM raster")
def gamma_correction(spark, sf_dir):
    return X.raster(spark, sf_dir).select("img", "y", "x", P.gamma(F.col("v"), 2.2).alias("v"))


@register(f"""{PX} SELECT img, y, x, round(fmod(degrees(atan2(y - 16.0::DOUBLE, x - 16.0::DOUBLE)) + 360.0, 360.0), 6) + 0.0 AS angle, round(sqrt(pow(x - 16.0::DOUBLE, 2) + pow(y - 16.0::DOUBLE, 2)), 6) AS radius,
  round(exp(v / -100.0::DOUBLE), 6) AS e, round(1 / (1 + exp(-(v - 128) / 32.0::DOUBLE)), 6) AS logistic, round((exp((v - 128) / 16.0::DOUBLE) - 1) / (exp((v - 128) / 16.0::DOUBLE) + 1), 6) + 0.0 AS tanh_ FROM raster""")
def transcendental(spark, sf_dir):
    x, y, v = F.col("x") - F.lit(16.0), F.col("y") - F.lit(16.0), F.col("v")
    return X.raster(spark, sf_dir).select("img", "y", "x", r6(P.degrees_of(y, x)).alias("angle"), F.round(F.hypot(x, y), 6).alias("radius"), F.round(F.exp(v / -100.0), 6).alias("e"), F.round(1 / (1 + F.exp(-(v - 128) / 32.0)), 6).alias("logistic"), r6(F.tanh((v - 128) / 32.0)).alias("tanh_"))


@register(f"""{VEC}, m AS (SELECT vec_id, e, list_max(e) AS top FROM vec), x AS (SELECT vec_id, list_transform(e, lambda a: exp(greatest(a - top, -86))) AS t FROM m)
SELECT vec_id, round(list_max(t) / list_sum(t), 6) AS largest, round(list_min(t) / list_sum(t), 6) AS least FROM x""")
def softmax(spark, sf_dir):
    s = X.vectors(spark, sf_dir).select("vec_id", P.softmax(F.col("e")).alias("s"))
    return s.select("vec_id", F.round(F.array_max("s"), 6).alias("largest"), F.round(F.array_min("s"), 6).alias("least"))


@register(f"{PT} SELECT set_id, i, round((2 * x + 0.1 * y + 3) / (0.01 * x + 1), 6) AS px, round((0.5 * x + 1.5 * y - 2) / (0.01 * x + 1), 6) AS py, round(abs(3 * x + 4 * y - 5) / 5, 6) AS line, round(abs(2 * x * x + 3 * x + 1 - y), 6) AS parabola, round(abs(2 * y * y + 3 * y + 1 - x), 6) AS sideways FROM pt")
def point_geometry(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    px, py = P.perspective([2.0, 0.1, 3.0, 0.5, 1.5, -2.0, 0.01, 0.0, 1.0], x, y)
    return X.points(spark, sf_dir).select("set_id", "i", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"), F.round(P.line_distance(3, 4, -5, x, y), 6).alias("line"), F.round(P.parabola_distance(2, 3, 1, x, y), 6).alias("parabola"), F.round(P.parabola_distance(2, 3, 1, x, y, sideways=True), 6).alias("sideways"))


# colour

_YUV = "least(greatest(((33 * r + 65 * g + 13 * b) >> 7) + 16, 0), 255) AS y, least(greatest(((-38 * r - 74 * g + 112 * b) >> 8) + 128, 0), 255) AS u, least(greatest(((112 * r - 94 * g - 18 * b) >> 8) + 128, 0), 255) AS v"


@register(f"{RGB} SELECT r, g, b, {_YUV} FROM rgb")
def rgb_to_yuv(spark, sf_dir):
    y, u, v = P.rgb_to_yuv(F.col("r"), F.col("g"), F.col("b"))
    return X.colours(spark, sf_dir).select("r", "g", "b", y.alias("y"), u.alias("u"), v.alias("v"))


@register(f"""{RGB} SELECT r AS y, g AS u, b AS v, least(greatest((37 * (r - 16) + 51 * (b - 127)) >> 5, 0), 255) AS red,
  least(greatest((37 * (r - 16) - 13 * (g - 127) - 26 * (b - 127)) >> 5, 0), 255) AS green, least(greatest((37 * (r - 16) + 65 * (g - 127)) >> 5, 0), 255) AS blue FROM rgb""")
def yuv_to_rgb(spark, sf_dir):
    r, g, b = P.yuv_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return X.colours(spark, sf_dir).select(F.col("r").alias("y"), F.col("g").alias("u"), F.col("b").alias("v"), r.alias("red"), g.alias("green"), b.alias("blue"))


_NEAREST = "trunc(q::DOUBLE + (CASE WHEN q >= 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END))"


@register(f"""{RGB}, m AS (SELECT *, greatest(r, g, b) AS t, greatest(r, g, b) - least(r, g, b) AS d FROM rgb),
h AS (SELECT *, CASE WHEN t = r THEN g - b WHEN t = g THEN b - r ELSE r - g END AS diff, CASE WHEN t = r THEN 0 WHEN t = g THEN 85 ELSE 171 END AS off FROM m),
q AS (SELECT *, CASE WHEN d = 0 THEN 0::FLOAT ELSE diff::FLOAT * (43::FLOAT * (1.0::DOUBLE / d)::FLOAT) END AS qh, CASE WHEN t = 0 THEN 0::FLOAT ELSE d::FLOAT * (255::FLOAT * (1.0::DOUBLE / t)::FLOAT) END AS qs FROM h)
SELECT r, g, b, CAST((CAST({_NEAREST.replace('q', 'qh')} AS INT) + off + 256) % 256 AS INT) AS h, CAST({_NEAREST.replace('q', 'qs')} AS INT) AS s, t AS v FROM q""")
def rgb_to_hsv(spark, sf_dir):
    h, s, v = P.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    return X.colours(spark, sf_dir).select("r", "g", "b", h.alias("h"), s.alias("s"), v.alias("v"))


@register(f"""{RGB}, p AS (SELECT *, ((r >> 3) << 11) | ((g >> 2) << 5) | (b >> 3) AS p FROM rgb)
SELECT r, g, b, p, ((p >> 11) << 3) | ((p >> 11) >> 2) AS r8, (((p >> 5) & 63) << 2) | (((p >> 5) & 63) >> 4) AS g8, ((p & 31) << 3) | ((p & 31) >> 2) AS b8 FROM p""")
def rgb565_round_trip(spark, sf_dir):
    c = X.colours(spark, sf_dir).withColumn("p", P.to_565(F.col("r"), F.col("g"), F.col("b")))
    r, g, b = P.from_565(F.col("p"))
    return c.select("r", "g", "b", "p", r.alias("r8"), g.alias("g8"), b.alias("b8"))


# selections and thresholds

@register(f"{PX} SELECT img, y, x, CASE WHEN v > 120 THEN 255 ELSE 0 END AS v FROM raster WHERE y BETWEEN 4 AND 27 AND x BETWEEN 6 AND 25")
def threshold_global_cropped(spark, sf_dir):
    return X.raster(spark, sf_dir).where("y BETWEEN 4 AND 27 AND x BETWEEN 6 AND 25").select("img", "y", "x", F.when(F.col("v") > 120, 255).otherwise(0).alias("v"))


_OTSU = f"""{PX}, c AS (SELECT img, v, count(*) AS n FROM raster GROUP BY 1, 2), every AS (SELECT img, t.v FROM (SELECT DISTINCT img FROM raster), (SELECT unnest(range(0, 256)) AS v) t),
s AS (SELECT e.img, e.v, sum(CASE WHEN c.v <= e.v THEN n ELSE 0 END) AS n0, sum(CASE WHEN c.v <= e.v THEN n * c.v ELSE 0 END) AS s0, sum(n) AS na, sum(n * c.v) AS sa FROM every e JOIN c ON c.img = e.img GROUP BY 1, 2),
b AS (SELECT img, v, round(CAST(n0 AS DOUBLE) * (na - n0) * pow(CAST(s0 AS DOUBLE) / n0 - CAST(sa - s0 AS DOUBLE) / (na - n0), 2), 3) AS b FROM s WHERE n0 > 0 AND n0 < na),
otsu AS (SELECT img, CAST(v AS INT) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY b DESC, v) AS k FROM b) WHERE k = 1)"""


@register(f"{_OTSU} SELECT img, threshold FROM otsu")
def threshold_otsu(spark, sf_dir):
    return A.otsu(X.raster(spark, sf_dir))


@register(f"{_OTSU} SELECT img, y, sum(CASE WHEN v > threshold THEN 255 ELSE 0 END)::BIGINT AS s FROM raster JOIN otsu USING (img) GROUP BY 1, 2")
def otsu_mask_rows(spark, sf_dir):
    px = X.raster(spark, sf_dir)
    return A.projection(A.binarise(px, A.otsu(px)), "y")


_MEAN5 = N.mean_kernel(5)[0]
_MEAN_SQL = f"""{PX}, every AS (SELECT i.img, CAST(gy AS INT) AS y, CAST(gx AS INT) AS x, coalesce(v, 0) AS v FROM (SELECT DISTINCT img FROM raster) i CROSS JOIN (SELECT unnest(range(0, 32)) AS gy) CROSS JOIN (SELECT unnest(range(0, 32)) AS gx) LEFT JOIN raster r ON r.img = i.img AND r.y = gy AND r.x = gx),
h AS (SELECT a.img, a.y, a.x, CASE WHEN a.x BETWEEN 2 AND 29 THEN least(sum((b.v * {_MEAN5})::BIGINT >> 16), 255) ELSE 0 END AS m FROM every a JOIN every b ON a.img = b.img AND a.y = b.y AND abs(a.x - b.x) <= 2 GROUP BY 1, 2, 3),
m AS (SELECT a.img, a.y, a.x, CASE WHEN a.y BETWEEN 2 AND 29 THEN least(sum((b.m * {_MEAN5})::BIGINT >> 16), 255) ELSE 0 END AS m FROM h a JOIN h b ON a.img = b.img AND a.x = b.x AND abs(a.y - b.y) <= 2 GROUP BY 1, 2, 3)"""


@register(f"{_MEAN_SQL} SELECT img, y, x, CASE WHEN v - m > -4 THEN 255 ELSE 0 END AS v FROM raster JOIN m USING (img, y, x)")
def threshold_adaptive(spark, sf_dir):
    return N.local_mean_threshold(X.raster(spark, sf_dir), 5, 4, SIZE)


@register(f"{_MEAN_SQL} SELECT img, y, x, CASE WHEN v - m > -21 THEN 0 ELSE 200 END AS v FROM raster JOIN m USING (img, y, x)")
def threshold_adaptive_inverted(spark, sf_dir):
    return N.local_mean_threshold(X.raster(spark, sf_dir), 5, 21, SIZE, most=200, invert=True)


@register(f"""{PX}, c AS (SELECT img, v, count(*) AS n FROM raster GROUP BY 1, 2), t AS (SELECT img, v, CAST(floor(sum(n) OVER (PARTITION BY img ORDER BY v) * 255.0::DOUBLE / sum(n) OVER (PARTITION BY img)) AS INT) AS q FROM c)
SELECT img, y, x, q AS v FROM raster JOIN t USING (img, v)""")
def histogram_equalise(spark, sf_dir):
    return A.equalise(X.raster(spark, sf_dir))


@register(f"{PX}, r AS (SELECT *, rank() OVER (PARTITION BY img ORDER BY v DESC) AS k FROM raster) SELECT img, y, x, v FROM r WHERE k <= 10")
def best_with_ties(spark, sf_dir):
    return M.best_with_ties(X.raster(spark, sf_dir), 10, "img", "v").select("img", "y", "x", "v")


# aggregations

@register(f"{PX}, every AS (SELECT img, t.v FROM (SELECT DISTINCT img FROM raster), (SELECT CAST(unnest(range(0, 256)) AS INT) AS v) t) SELECT e.img, e.v, count(r.v) AS n FROM every e LEFT JOIN raster r ON r.img = e.img AND r.v = e.v GROUP BY 1, 2")
def histogram(spark, sf_dir):
    return A.histogram(X.raster(spark, sf_dir))


@register(f"{PX} SELECT img, x, sum(v)::BIGINT AS s FROM raster GROUP BY 1, 2")
def projection_columns(spark, sf_dir):
    return A.projection(X.raster(spark, sf_dir), "x")


@register(f"{PX} SELECT img, min(v) AS low, max(v) AS high, sum(v)::BIGINT AS total, round(avg(v), 6) AS mean, round(sum(pow(v - 100.0::DOUBLE, 2)) / (count(*) - 1), 4) AS variance FROM raster GROUP BY 1")
def min_max_mean_variance(spark, sf_dir):
    v = F.col("v")
    return X.raster(spark, sf_dir).groupBy("img").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.sum(v).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.round(A.variance_about(v, 100.0), 4).alias("variance"))


_MOM = """m AS (SELECT img, sum(v)::BIGINT AS m00, sum(v * x)::BIGINT AS m10, sum(v * y)::BIGINT AS m01, sum(v * x * y)::BIGINT AS m11, sum(v * x * x)::BIGINT AS m20, sum(v * y * y)::BIGINT AS m02 FROM raster GROUP BY 1),
u AS (SELECT *, m11 - CAST(m10 AS DOUBLE) * m01 / m00 AS u11, m20 - CAST(m10 AS DOUBLE) * m10 / m00 AS u20, m02 - CAST(m01 AS DOUBLE) * m01 / m00 AS u02 FROM m)"""


@register(f"{PX}, {_MOM} SELECT img, m00, m10, m01, m11, m20, m02, round(u11 / u02, 6) + 0.0 AS skewness, round(0.5 * atan2(2 * u11, u20 - u02), 6) + 0.0 AS orientation FROM u")
def image_moments(spark, sf_dir):
    m = A.moments(X.raster(spark, sf_dir), ["img"])
    return m.withColumn("skewness", r6(F.col("skewness"))).withColumn("orientation", r6(F.col("orientation")))


@register(f"""{PT}, c AS (SELECT set_id, avg(x) AS tx, avg(y) AS ty FROM pt GROUP BY 1)
SELECT set_id, round(any_value(tx), 6) AS tx, round(any_value(ty), 6) AS ty, round(sqrt(2) / avg(sqrt(pow(x - tx, 2) + pow(y - ty, 2))), 6) AS s FROM pt JOIN c USING (set_id) GROUP BY 1 HAVING count(*) > 1""")
def hartley_normalisation(spark, sf_dir):
    h = A.hartley(X.points(spark, sf_dir), "set_id").where("s IS NOT NULL")
    return h.select("set_id", *[F.round(c, 6).alias(c) for c in ("tx", "ty", "s")])


@register(f"{VEC} SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS l2, round(list_inner_product(e, e), 6) AS dot, round(list_max(e) - list_min(e), 6) AS spread, round(list_avg(e), 6) + 0.0 AS mean FROM vec")
def vector_norms(spark, sf_dir):
    e = F.col("e")
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return X.vectors(spark, sf_dir).select("vec_id", F.round(F.sqrt(P.dot(e, e)), 6).alias("l2"), F.round(P.dot(e, e), 6).alias("dot"), F.round(F.array_max(e) - F.array_min(e), 6).alias("spread"), r6(total / F.size(e)).alias("mean"))


@register(f"""{VEC}, p AS (SELECT vec_id, unnest(e) AS a, generate_subscripts(e, 1) - 1 AS i FROM vec)
SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(covar_samp(a.a, b.a), 5) + 0.0 AS cov FROM p a JOIN p b USING (vec_id) WHERE a.i <= b.i GROUP BY 1, 2""")
def covariance_matrix(spark, sf_dir):
    c = A.covariance(X.vectors(spark, sf_dir), 64)
    return c.select("i", "j", (F.round("cov", 5) + F.lit(0.0)).alias("cov"))


@register(f"{PX} SELECT a.img, a.y AS i, b.x AS j, sum(a.v * b.v)::BIGINT AS v FROM raster a JOIN raster b ON a.img = b.img AND a.x = b.y GROUP BY 1, 2, 3")
def matrix_product(spark, sf_dir):
    cells = X.raster(spark, sf_dir).select("img", F.col("y").alias("i"), F.col("x").alias("j"), "v")
    return A.matrix_product(cells, cells, ["img"])


@register(f"{PX} SELECT a.img, a.x AS i, b.x AS j, sum(a.v * b.v)::BIGINT AS v FROM raster a JOIN raster b ON a.img = b.img AND a.y = b.y GROUP BY 1, 2, 3")
def matrix_gram(spark, sf_dir):
    return A.gram(X.raster(spark, sf_dir).select("img", F.col("y").alias("i"), F.col("x").alias("j"), "v"), ["img"])


@register(f"{PX} SELECT a.img, a.y AS i, b.y AS j, sum(a.v * b.v)::BIGINT AS v FROM raster a JOIN raster b ON a.img = b.img AND a.x = b.x GROUP BY 1, 2, 3")
def matrix_times_transpose(spark, sf_dir):
    cells = X.raster(spark, sf_dir).select("img", F.col("y").alias("i"), F.col("x").alias("j"), "v")
    return A.matrix_product(cells, A.transposed(cells), ["img"])


@register(f"""{PX} SELECT img, CAST(y AS INT) AS i, CAST(x AS INT) AS j, v AS most FROM raster WHERE y <> x QUALIFY row_number() OVER (PARTITION BY img ORDER BY v DESC, y, x) = 1""")
def greatest_off_diagonal(spark, sf_dir):
    return A.off_diagonal(X.raster(spark, sf_dir).select("img", F.col("y").alias("i"), F.col("x").alias("j"), "v"), "img")


@register(f"""{PX}, s AS (SELECT img, y, x, v FROM raster UNION ALL SELECT 100 + img, x, y, v FROM raster UNION ALL SELECT 100 + img, y, x, v FROM raster), c AS (SELECT img, y, x, sum(v)::BIGINT AS v FROM s GROUP BY 1, 2, 3)
SELECT a.img, bool_and(coalesce(a.v = b.v, false)) AS symmetric FROM c a LEFT JOIN c b ON a.img = b.img AND a.y = b.x AND a.x = b.y GROUP BY 1""")
def symmetric_matrices(spark, sf_dir):
    cells = X.raster(spark, sf_dir).select("img", F.col("y").alias("i"), F.col("x").alias("j"), "v")
    moved = cells.withColumn("img", F.col("img") + 100)
    both = moved.unionByName(A.transposed(moved, ["img"])).groupBy("img", "i", "j").agg(F.sum("v").alias("v"))
    return A.is_symmetric(cells.unionByName(both), "img")


@register(f"""{PT} SELECT set_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)), 6) + 0.0 AS angle FROM pt GROUP BY 1""")
def fit_line(spark, sf_dir):
    f = A.fit_line(X.points(spark, sf_dir), "set_id")
    return f.select("set_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), r6(F.col("angle")).alias("angle"))


@register(f"""{PT}, c AS (SELECT set_id, avg(x) AS x0 FROM pt GROUP BY 1), s AS (SELECT set_id, any_value(x0) AS x0, count(*)::DOUBLE AS n, count(DISTINCT x) AS k, sum(pow(x - x0, 2)) AS s2, sum(pow(x - x0, 3)) AS s3, sum(pow(x - x0, 4)) AS s4,
  sum(y) AS t0, sum((x - x0) * y) AS t1, sum(pow(x - x0, 2) * y) AS t2 FROM pt JOIN c USING (set_id) GROUP BY 1),
a AS (SELECT *, CASE WHEN k >= 3 THEN (n * s2 * t2 - n * s3 * t1 - s2 * s2 * t0) / nullif(n * s2 * s4 - s2 * s2 * s2 - n * s3 * s3, 0) END AS a FROM s), b AS (SELECT *, (t1 - a * s3) / nullif(s2, 0) AS bu, (t0 - a * s2) / n AS cu FROM a)
SELECT set_id, round(a, 4) + 0.0 AS a, round(bu - 2 * a * x0, 3) + 0.0 AS b, round(cu - bu * x0 + a * x0 * x0, 2) + 0.0 AS c FROM b""")
def fit_parabola(spark, sf_dir):
    f = A.fit_parabola(X.points(spark, sf_dir), "set_id")
    return f.select("set_id", *[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in (("a", 4), ("b", 3), ("c", 2))])


# neighbourhoods

@register(f"""{PX}, f AS (SELECT img, max(y) + 1 AS h, max(x) + 1 AS w FROM raster GROUP BY 1), g AS (SELECT img, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM f, (SELECT unnest(range(0, 33)) AS y), (SELECT unnest(range(0, 33)) AS x) WHERE y <= h AND x <= w)
SELECT g.img, g.y, g.x, coalesce(sum(r.v), 0)::DOUBLE AS s, coalesce(sum(r.v * r.v), 0)::DOUBLE AS q FROM g LEFT JOIN raster r ON r.img = g.img AND r.y < g.y AND r.x < g.x GROUP BY 1, 2, 3""")
def integral_image(spark, sf_dir):
    return N.integral(X.raster(spark, sf_dir))


_NB = "FROM raster a JOIN raster b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"


_SMOOTH = "sum(b.v * (CASE WHEN a.y = b.y THEN 2 ELSE 1 END) * (CASE WHEN a.x = b.x THEN 2 ELSE 1 END)) / 16.0"
_K16 = [(2 if dy == 0 else 1) * (2 if dx == 0 else 1) / 16.0 for dy, dx in N.NINE]


@register(f"{PX} SELECT a.img, a.y, a.x, CASE WHEN {IN3} THEN CAST(round({_SMOOTH}, 4) AS DOUBLE) ELSE 0.0 END AS v {_NB} GROUP BY 1, 2, 3")
def convolution_3x3(spark, sf_dir):
    return N.correlate(X.raster(spark, sf_dir), N.NINE, _K16, SIZE).select("img", "y", "x", F.round("s", 4).alias("v"))


@register(f"{PX} SELECT a.img, a.y, a.x, CASE WHEN {IN3} THEN CAST(round({_SMOOTH}, 4) AS DOUBLE) ELSE any_value(a.v)::DOUBLE END AS v {_NB} GROUP BY 1, 2, 3")
def convolution_replicated(spark, sf_dir):
    return N.correlate(X.raster(spark, sf_dir), N.NINE, _K16, SIZE, border="replicate").select("img", "y", "x", F.round("s", 4).alias("v"))


@register(f"{PX} SELECT a.img, a.y, a.x, CAST(round({_SMOOTH}, 4) AS DOUBLE) AS v {_NB} WHERE {IN3} GROUP BY 1, 2, 3")
def convolution_inside(spark, sf_dir):
    return N.correlate(X.raster(spark, sf_dir), N.NINE, _K16, SIZE, border="ignore").select("img", "y", "x", F.round("s", 4).alias("v"))


@register(f"""{PX}, h AS (SELECT a.img, a.y, a.x, CASE WHEN a.x BETWEEN 1 AND 30 THEN least(sum((b.v * (CASE WHEN a.x = b.x THEN 32767 ELSE 16383 END)) >> 16), 255) ELSE 0 END AS v FROM raster a JOIN raster b ON a.img = b.img AND a.y = b.y AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3)
SELECT a.img, a.y, a.x, CAST(CASE WHEN a.y BETWEEN 1 AND 30 THEN least(sum((b.v * (CASE WHEN a.y = b.y THEN 32767 ELSE 16383 END))::BIGINT >> 16), 255) ELSE 0 END AS INT) AS v FROM h a JOIN h b ON a.img = b.img AND a.x = b.x AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3""")
def convolution_fixed_point(spark, sf_dir):
    kernel = [16383, 32767, 16383]
    return N.correlate_fixed(N.correlate_fixed(X.raster(spark, sf_dir), kernel, False, SIZE), kernel, True, SIZE)


def _edge_sql(a: tuple[int, int, int]) -> str:
    w = lambda d: f"(CASE WHEN {d} = 0 THEN {a[1]} ELSE {a[0]} END)"
    return f"""{PX}, g AS (SELECT a.img, a.y, a.x, CASE WHEN {IN3} THEN abs(sum(b.v * (b.x - a.x) * {w('b.y - a.y')})) + abs(sum(b.v * (b.y - a.y) * {w('b.x - a.x')})) ELSE 0 END AS g {_NB} GROUP BY 1, 2, 3)
SELECT img, y, x, CAST(floor(g * 255.0::DOUBLE / greatest(max(g) OVER (PARTITION BY img), 1)) AS INT) AS v FROM g"""


def _edges(name: str) -> Query:
    def f(spark, sf_dir):
        return N.edges(X.raster(spark, sf_dir), name, SIZE)

    f.__name__ = f"edges_{name}"
    return register(_edge_sql(N.KERNELS[name]))(f)


for _name in N.KERNELS:
    _edges(_name)


_DIFF_SQL = f"""{PX}, g AS (SELECT a.img, a.y, a.x, CASE WHEN a.x BETWEEN 1 AND 30 THEN sum(CASE WHEN b.y = a.y THEN b.v * (b.x - a.x) ELSE 0 END) ELSE 0 END::BIGINT AS gx,
  CASE WHEN a.y BETWEEN 1 AND 30 THEN sum(CASE WHEN b.x = a.x THEN b.v * (b.y - a.y) ELSE 0 END) ELSE 0 END::BIGINT AS gy FROM raster a JOIN raster b ON a.img = b.img AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3)"""


@register(f"{_DIFF_SQL} SELECT * FROM g")
def gradient_xy(spark, sf_dir):
    return N.differences(X.raster(spark, sf_dir), SIZE)


@register(f"{_DIFF_SQL} SELECT img, y, x, round(sqrt((gx * gx + gy * gy)::DOUBLE), 6) AS magnitude, round(fmod(degrees(atan2(gy::DOUBLE, gx::DOUBLE)) + 360.0, 360.0), 6) + 0.0 AS direction FROM g")
def gradient_polar(spark, sf_dir):
    g = N.polar(N.differences(X.raster(spark, sf_dir), SIZE))
    return g.select("img", "y", "x", F.round("magnitude", 6).alias("magnitude"), r6(F.col("direction")).alias("direction"))


def _morph_sql(op: str) -> str:
    cond = "AND (a.y = b.y OR a.x = b.x)"
    one = lambda src, f: f"SELECT a.img, a.y, a.x, {f}(b.v) AS v FROM {src} a JOIN {src} b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 {cond} GROUP BY 1, 2, 3"
    if op in ("erode", "dilate"):
        return f"{PX} {one('raster', 'min' if op == 'erode' else 'max')}"
    if op == "gradient":
        return f"{PX} {one('raster', 'max').replace('max(b.v)', 'max(b.v) - min(b.v)')}"
    if op in ("tophat", "blackhat"):
        v = "r.v - o.v" if op == "tophat" else "o.v - r.v"
        f, g = ("min", "max") if op == "tophat" else ("max", "min")
        return f"{PX}, s AS ({one('raster', f)}), o AS ({one('s', g)}) SELECT r.img, r.y, r.x, {v} AS v FROM raster r JOIN o USING (img, y, x)"
    f, g = ("min", "max") if op == "open" else ("max", "min")
    return f"{PX}, s AS ({one('raster', f)}) {one('s', g)}"


def _morph(op: str) -> Query:
    def f(spark, sf_dir):
        return N.morph(X.raster(spark, sf_dir), op, "cross")

    f.__name__ = f"morph_{op}"
    return register(_morph_sql(op))(f)


for _name in ("erode", "dilate", "open", "close"):
    _morph(_name)


@register(f"{PX} SELECT a.img, a.y, a.x, any_value(a.v) AS v FROM raster a LEFT JOIN raster b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY 1, 2, 3 HAVING coalesce(max(b.v), -1) < any_value(a.v)")
def non_maximum_suppression(spark, sf_dir):
    return N.strict_peaks(X.raster(spark, sf_dir))


_RING_SQL = ", ".join(f"({k}, {dy}, {dx})" for k, (dy, dx) in enumerate(N.RING))


@register(f"""{PX}, ring(k, dy, dx) AS (VALUES {_RING_SQL}), d AS (SELECT a.img, a.y, a.x, list(b.v - a.v ORDER BY k) AS d FROM raster a, ring JOIN raster b ON b.y = a.y + dy AND b.x = a.x + dx AND b.img = a.img GROUP BY 1, 2, 3 HAVING count(*) = 16),
s AS (SELECT img, y, x, s, list_concat(d, d)[s : s + 8] AS arc FROM d, (SELECT unnest(range(1, 17)) AS s)), m AS (SELECT img, y, x, max(greatest(list_min(arc), -list_max(arc))) AS m FROM s GROUP BY 1, 2, 3)
SELECT img, y, x, CAST(m - 1 AS INT) AS strength FROM m WHERE m > 20""")
def fast_corners(spark, sf_dir):
    return N.fast_corners(X.raster(spark, sf_dir), 20, 9)


@register(f"""{_DIFF_SQL}
SELECT img, y // 8 AS cy, x // 8 AS cx, CAST(least(floor(fmod(degrees(atan2(gy, gx)) + 180.0, 180.0) / 20.0), 8) AS BIGINT) AS bin, round(sum(sqrt(gx * gx + gy * gy)), 4) AS weight FROM g GROUP BY 1, 2, 3, 4""")
def hog_cells(spark, sf_dir):
    h = N.hog_cells(X.raster(spark, sf_dir), SIZE)
    return h.select("img", F.col("cy").cast("int").alias("cy"), F.col("cx").cast("int").alias("cx"), F.col("bin").cast("long").alias("bin"), F.round("weight", 4).alias("weight"))


@register(f"""{PX} SELECT img, CAST(floor(x * cos(radians(t * 180.0::DOUBLE / 180)) + y * sin(radians(t * 180.0::DOUBLE / 180)) + 0.5 + 1e-9) AS INT) AS rho, CAST(t AS INT) AS t, count(*) AS votes
FROM raster, (SELECT unnest(range(0, 180)) AS t) WHERE v > 200 GROUP BY 1, 2, 3 HAVING count(*) > 5""")
def hough_lines(spark, sf_dir):
    return N.hough_lines(X.raster(spark, sf_dir).where("v > 200"))


@register(f"""{PX}, o AS (SELECT i.img, y.y, x.x FROM (SELECT DISTINCT img FROM raster) i, (SELECT CAST(unnest(range(0, 24)) AS INT) AS y) y, (SELECT CAST(unnest(range(0, 40)) AS INT) AS x) x),
f AS (SELECT *, y * 341 AS fy, x * 204 AS fx FROM o), c AS (SELECT img, y, x, least((fy >> 8) + dy, 31) AS sy, least((fx >> 8) + dx, 31) AS sx, (CASE WHEN dy = 1 THEN fy & 255 ELSE 256 - (fy & 255) END) * (CASE WHEN dx = 1 THEN fx & 255 ELSE 256 - (fx & 255) END) AS w
FROM f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(dy, dx))
SELECT c.img, c.y, c.x, CAST(sum(w * coalesce(r.v, 0))::BIGINT >> 16 AS INT) AS v FROM c LEFT JOIN raster r ON r.img = c.img AND r.y = c.sy AND r.x = c.sx GROUP BY 1, 2, 3""")
def resize_bilinear(spark, sf_dir):
    return N.resize_bilinear(X.raster(spark, sf_dir), 32, 32, 40, 24)


@register(f"""{PX}, o AS (SELECT i.img, y.y, x.x FROM (SELECT DISTINCT img FROM raster) i, (SELECT CAST(unnest(range(0, 32)) AS INT) AS y) y, (SELECT CAST(unnest(range(0, 32)) AS INT) AS x) x)
SELECT o.img, o.y, o.x, coalesce(r.v, 0) AS v FROM o LEFT JOIN raster r ON r.img = o.img AND r.x = floor(0.75::DOUBLE * o.x - 0.5::DOUBLE * o.y + 8.0 + 0.5) AND r.y = floor(0.5::DOUBLE * o.x + 0.75::DOUBLE * o.y - 4.0 + 0.5)""")
def warp_affine(spark, sf_dir):
    return N.warp_affine(X.raster(spark, sf_dir), [0.75, -0.5, 8.0, 0.5, 0.75, -4.0], 32, 32)


for _name in ("gradient", "tophat", "blackhat"):
    _morph(_name)


_BELL = ", ".join(f"({i - 2}, {w!r}::DOUBLE)" for i, w in enumerate(N.gaussian_kernel(5, 2.0)))


@register(f"""{PX}, bell(d, w) AS (VALUES {_BELL}), h AS (SELECT a.img, a.y, a.x, CASE WHEN a.x BETWEEN 2 AND 29 THEN sum(b.v * w) ELSE 0.0 END AS s FROM raster a JOIN raster b ON a.img = b.img AND a.y = b.y JOIN bell ON b.x = a.x + d GROUP BY 1, 2, 3)
SELECT a.img, a.y, a.x, round(CASE WHEN a.y BETWEEN 2 AND 29 THEN sum(b.s * w) ELSE 0.0 END, 4) AS v FROM h a JOIN h b ON a.img = b.img AND a.x = b.x JOIN bell ON b.y = a.y + d GROUP BY 1, 2, 3""")
def gaussian_blur(spark, sf_dir):
    return N.separable(X.raster(spark, sf_dir), N.gaussian_kernel(5, 2.0), SIZE).select("img", "y", "x", F.round("s", 4).alias("v"))


_THIN = f"""g AS (SELECT a.img, a.y, a.x, CASE WHEN {IN3} THEN sum(b.v * (b.x - a.x) * (CASE WHEN b.y = a.y THEN 2 ELSE 1 END)) ELSE 0 END AS gx, CASE WHEN {IN3} THEN sum(b.v * (b.y - a.y) * (CASE WHEN b.x = a.x THEN 2 ELSE 1 END)) ELSE 0 END AS gy {_NB} GROUP BY 1, 2, 3),
m AS (SELECT *, abs(gx) + abs(gy) AS v, CASE WHEN abs(gy) < abs(gx) * 0.41421356237309503::DOUBLE THEN 0 WHEN abs(gy) > abs(gx) * 2.414213562373095::DOUBLE THEN 1 WHEN (gx > 0) = (gy > 0) THEN 2 ELSE 3 END AS way FROM g),
p AS (SELECT a.img, a.y, a.x, any_value(a.v) AS v, a.img * 10000 + a.y * 100 + a.x AS id FROM m a LEFT JOIN m b ON a.img = b.img AND ((a.way = 0 AND b.y = a.y AND abs(b.x - a.x) = 1) OR (a.way = 1 AND b.x = a.x AND abs(b.y - a.y) = 1)
  OR (a.way = 2 AND abs(b.x - a.x) = 1 AND b.y - a.y = b.x - a.x) OR (a.way = 3 AND abs(b.x - a.x) = 1 AND b.y - a.y = a.x - b.x)) WHERE a.v > 300 GROUP BY 1, 2, 3 HAVING coalesce(max(b.v), 0) <= any_value(a.v))"""


@register(f"{PX.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_THIN}" + """, e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
reach AS (SELECT id FROM p WHERE v > 600 UNION SELECT e.b FROM reach r JOIN e ON r.id = e.a) SELECT img, y, x FROM p JOIN reach USING (id)""")
def canny_edges(spark, sf_dir):
    return N.canny(X.raster(spark, sf_dir), 300, 600, SIZE)


_CUBIC = "(CASE k WHEN 0 THEN (-f * f * f + 2 * f * f - f) / 2 WHEN 1 THEN (3 * f * f * f - 5 * f * f + 2) / 2 WHEN 2 THEN (-3 * f * f * f + 4 * f * f + f) / 2 ELSE (f * f * f - f * f) / 2 END)"


@register(f"""{PX}, ax AS (SELECT n, CAST(i AS INT) AS i, CAST(k AS INT) AS k, (i + 0.5::DOUBLE) * (32.0::DOUBLE / (n - 1)) - 0.5 AS p FROM (VALUES (24), (40)) AS t(n), (SELECT unnest(range(0, 40)) AS i), (SELECT unnest(range(0, 4)) AS k) WHERE i < n),
bx AS (SELECT n, i, k, greatest(least(CAST(trunc(p) AS INT) + k - 1, 31), 0) AS c, p - trunc(p) AS f FROM ax), w AS (SELECT n, i, c, {_CUBIC} AS w FROM bx)
SELECT i.img, a.i AS y, b.i AS x, CAST(floor(least(greatest(round(sum(a.w * b.w * coalesce(v, 0)), 6), 0.0), 255.0)) AS INT) AS v
FROM (SELECT DISTINCT img FROM raster) i CROSS JOIN w a JOIN w b ON a.n = 24 AND b.n = 40 LEFT JOIN raster r ON r.img = i.img AND r.y = a.c AND r.x = b.c GROUP BY 1, 2, 3""")
def resize_bicubic(spark, sf_dir):
    return N.resize_bicubic(X.raster(spark, sf_dir), 32, 32, 40, 24)


def _level_sql(n: int, side: int) -> str:
    if n == 0:
        return "SELECT img, 0 AS level, y, x, v FROM raster"
    step = 32 * 256 // side
    return f"""SELECT c.img, {n} AS level, c.y, c.x, CAST(sum(w * coalesce(r.v, 0))::BIGINT >> 16 AS INT) AS v FROM (SELECT img, y, x, least((fy >> 8) + dy, 31) AS sy, least((fx >> 8) + dx, 31) AS sx,
  (CASE WHEN dy = 1 THEN fy & 255 ELSE 256 - (fy & 255) END) * (CASE WHEN dx = 1 THEN fx & 255 ELSE 256 - (fx & 255) END) AS w
  FROM (SELECT i.img, CAST(yy AS INT) AS y, CAST(xx AS INT) AS x, yy * {step} AS fy, xx * {step} AS fx FROM (SELECT DISTINCT img FROM raster) i, (SELECT unnest(range(0, {side})) AS yy), (SELECT unnest(range(0, {side})) AS xx)), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(dy, dx)) c
LEFT JOIN raster r ON r.img = c.img AND r.y = c.sy AND r.x = c.sx GROUP BY 1, 2, 3, 4"""


@register(f"{PX} " + " UNION ALL ".join(_level_sql(n, int(32 * 0.83**n)) for n in range(4)))
def scale_pyramid(spark, sf_dir):
    return N.pyramid(X.raster(spark, sf_dir), 32, 32, 0.83, 4)


_LENS_SQL = "(0.2::DOUBLE * r2 + 1 - 0.05::DOUBLE * r2 * r2)"
_MAP_SQL = f"""o AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, (x - 16.0::DOUBLE) / 40 AS u, (y - 16.0::DOUBLE) / 40 AS w FROM (SELECT unnest(range(0, 32)) AS y), (SELECT unnest(range(0, 32)) AS x)),
q AS (SELECT *, u * u + w * w AS r2 FROM o), m AS (SELECT y, x, 40 * (u * {_LENS_SQL} + 2 * 0.01::DOUBLE * u * w + 0.02::DOUBLE * (r2 + 2 * u * u)) + 16 AS sx, 40 * (w * {_LENS_SQL} + 0.01::DOUBLE * (r2 + 2 * w * w) + 2 * 0.02::DOUBLE * u * w) + 16 AS sy FROM q)"""
LENS = (0.2, -0.05, 0.01, 0.02)


def _straighten(spark: SparkSession) -> DataFrame:
    return C.undistortion_map(32, 32, (40.0, 40.0), (16.0, 16.0), LENS, spark)


@register(f"WITH {_MAP_SQL} SELECT y, x, round(sx, 6) AS sx, round(sy, 6) AS sy FROM m")
def undistortion_map(spark, sf_dir):
    return _straighten(spark).select("y", "x", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"))


@register(f"""{PX}, {_MAP_SQL}, n AS (SELECT img, m.*, CAST(floor(sy) AS INT) AS iy, CAST(floor(sx) AS INT) AS ix FROM m, (SELECT DISTINCT img FROM raster) i),
c AS (SELECT n.*, least(iy + a, 31) AS cy, least(ix + b, 31) AS cx, (CASE WHEN a = 1 THEN sy - iy ELSE 1 - sy + iy END) * (CASE WHEN b = 1 THEN sx - ix ELSE 1 - sx + ix END) AS w FROM n, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(a, b))
SELECT c.img, c.y, c.x, CASE WHEN any_value(sy) BETWEEN 0 AND 31 AND any_value(sx) BETWEEN 0 AND 31 THEN CAST(floor(round(sum(w * coalesce(v, 0)), 6)) AS INT) ELSE 0 END AS v FROM c LEFT JOIN raster r ON r.img = c.img AND r.y = c.cy AND r.x = c.cx GROUP BY 1, 2, 3""")
def undistort_image(spark, sf_dir):
    return N.remap_bilinear(X.raster(spark, sf_dir), _straighten(spark), 32, 32, 32, 32)


@register(f"""{PX} SELECT a.img, a.y, a.x, sum(b.v * (b.x - a.x))::BIGINT AS m10, sum(b.v * (b.y - a.y))::BIGINT AS m01, round(fmod(degrees(atan2(sum(b.v * (b.y - a.y))::DOUBLE, sum(b.v * (b.x - a.x))::DOUBLE)) + 360.0, 360.0), 6) + 0.0 AS angle
FROM raster a JOIN raster b ON a.img = b.img AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 9 GROUP BY 1, 2, 3""")
def patch_orientation(spark, sf_dir):
    return N.patch_orientation(X.raster(spark, sf_dir), 7).withColumn("angle", r6(F.col("angle")))


_VOTES = f"""{PX}, votes AS (SELECT img, CAST(floor(x * cos(radians(t * 1.0::DOUBLE)) + y * sin(radians(t * 1.0::DOUBLE)) + 0.5 + 1e-9) AS INT) AS rho, CAST(t AS INT) AS t, count(*) AS votes
FROM raster, (SELECT unnest(range(0, 180)) AS t) WHERE v > 200 GROUP BY 1, 2, 3 HAVING count(*) > 5),
peak AS (SELECT a.* FROM votes a JOIN votes b ON a.img = b.img AND abs(a.rho - b.rho) <= 1 AND abs(a.t - b.t) <= 1 GROUP BY ALL HAVING max(b.votes) = a.votes),
top AS (SELECT * FROM peak QUALIFY row_number() OVER (PARTITION BY img ORDER BY votes DESC, rho, t) <= 10)"""


@register(_VOTES + """ SELECT img, rho, t, votes, round(CASE WHEN t = 0 THEN rho ELSE 0.0::DOUBLE END, 4) AS x0, round(CASE WHEN t = 0 THEN 0.0::DOUBLE ELSE rho / sin(radians(t::DOUBLE)) END, 4) AS y0,
  round(CASE WHEN t = 0 THEN rho ELSE 32.0::DOUBLE END, 4) AS x1, round(CASE WHEN t = 0 THEN 32.0::DOUBLE ELSE (rho - 32 * cos(radians(t::DOUBLE))) / sin(radians(t::DOUBLE)) END, 4) AS y1 FROM top""")
def hough_segments(spark, sf_dir):
    lines = N.hough_peaks(N.hough_lines(X.raster(spark, sf_dir).where("v > 200")), 10)
    s = N.to_segments(lines, 32, 32)
    return s.select("img", "rho", "t", "votes", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("x0", "y0", "x1", "y1")])


@register(f"{PX}, b AS (SELECT * FROM raster WHERE y BETWEEN 5 AND 26 AND x BETWEEN 5 AND 26) SELECT img, y, x, v FROM b")
def erase_border(spark, sf_dir):
    return M.away_from_border(X.raster(spark, sf_dir), 32, 32, 5)


# matching

def _nearest_sql(distance: str, k: int) -> str:
    return f"""{VEC}, p AS (SELECT q.vec_id AS query_id, t.vec_id, round({distance}, 9) AS distance FROM vec q JOIN vec t ON q.vec_id % 20 = 0 AND q.vec_id <> t.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM p), near AS (SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= {k})"""


_L2 = "list_sum(list_transform(range(1, len(q.e) + 1), lambda i: pow(q.e[i] - t.e[i], 2)))"
_L1 = "list_sum(list_transform(range(1, len(q.e) + 1), lambda i: abs(q.e[i] - t.e[i])))"
_ANGLE = "2 - 2 * list_inner_product(q.e, t.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(t.e, t.e))"


def _near(spark: SparkSession, sf_dir: str, k: int, metric: str) -> DataFrame:
    v = X.vectors(spark, sf_dir)
    return M.nearest(v, v.where("vec_id % 20 = 0"), k, metric).withColumn("distance", F.round("distance", 6))


def _knn(metric: str, distance: str) -> Query:
    def f(spark, sf_dir):
        return _near(spark, sf_dir, 5, metric)

    f.__name__ = f"nearest_{metric}"
    return register(_nearest_sql(distance, 5) + " SELECT * FROM near")(f)


for _name, _d in (("euclidean", _L2), ("manhattan", _L1), ("angular", _ANGLE)):
    _knn(_name, _d)


@register(_nearest_sql(_L2, 2) + " SELECT a.query_id, a.vec_id, a.distance FROM near a JOIN near b ON a.query_id = b.query_id AND a.rank = 1 AND b.rank = 2 WHERE a.distance < 0.9 * b.distance")
def match_ratio_test(spark, sf_dir):
    return M.ratio_test(_near(spark, sf_dir, 2, "euclidean"), 0.9)


@register(f"{VEC} SELECT vec_id, round(0.25 + 0.5 * exp(-0.1 * list_inner_product(e, e)) - 0.75 * exp(-0.1 * list_sum(list_transform(e, lambda x: pow(x - 0.5, 2)))), 6) AS score FROM vec")
def kernel_machine_scores(spark, sf_dir):
    s = M.rbf_scores(X.vectors(spark, sf_dir), [([0.0] * 64, 0.5), ([0.5] * 64, -0.75)], 0.1, 0.25)
    return s.select("vec_id", F.round("score", 6).alias("score"))


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.vectors(spark, sf_dir).select("vec_id", M.sign_bits(F.col("e")).alias("e"))


_BITS_SQL = f"""{VEC}, bits AS (SELECT vec_id, list_transform(e, lambda a: CASE WHEN a > 0 THEN 1 ELSE 0 END) AS e FROM vec)"""
_HAM = "list_sum(list_transform(range(1, 65), lambda i: xor(q.e[i], t.e[i])))"


def _hamming_sql(queries: str, k: int) -> str:
    return f"""{_BITS_SQL}, p AS (SELECT q.vec_id AS query_id, t.vec_id, CAST({_HAM} AS INT) AS distance FROM bits q JOIN bits t ON {queries} AND q.vec_id <> t.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM p), near AS (SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= {k})"""


@register(_hamming_sql("q.vec_id % 20 = 0", 2) + " SELECT * FROM near")
def hamming_matches(spark, sf_dir):
    b = _bits(spark, sf_dir)
    return M.nearest(b, b.where("vec_id % 20 = 0"), 2, "hamming")


@register(_hamming_sql("q.vec_id % 20 = 0", 1) + f""", back AS (SELECT b.vec_id, q.vec_id AS query_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_HAM}, q.vec_id) AS n
  FROM (SELECT DISTINCT vec_id FROM near) b JOIN bits t ON t.vec_id = b.vec_id JOIN bits q ON q.vec_id % 20 = 0 AND q.vec_id <> t.vec_id)
SELECT a.query_id, a.vec_id, a.distance FROM near a JOIN back b ON b.n = 1 AND a.vec_id = b.vec_id AND a.query_id = b.query_id""")
def cross_checked_matches(spark, sf_dir):
    b = _bits(spark, sf_dir)
    queries = b.where("vec_id % 20 = 0")
    return M.cross_check(M.nearest(b, queries, 1, "hamming"), b, queries, "hamming")


# vectors, matrices and cameras

@register(f"""{VEC}, m AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS l, list_min(e) AS low, list_max(e) AS high, list_avg(e) AS a, sqrt(list_sum(list_transform(e, lambda x: pow(x - list_avg(e), 2))) / (len(e) - 1)) AS sd FROM vec)
SELECT vec_id, CAST(i AS INT) AS i, round(e[i + 1] / l, 6) + 0.0 AS l2, round((e[i + 1] - low) / (high - low), 6) + 0.0 AS minmax, round((e[i + 1] - a) / (sd + 1e-9), 5) + 0.0 AS z FROM m, (SELECT unnest(range(0, 64)) AS i)""")
def normalised_vectors(spark, sf_dir):
    e = F.col("e")
    n = X.vectors(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip(P.unit_l2(e).alias("l2"), P.unit_range(e).alias("minmax"), P.z_scores(e).alias("z"))).alias("i", "c"))
    return n.select("vec_id", "i", r6(F.col("c.l2")).alias("l2"), r6(F.col("c.minmax")).alias("minmax"), (F.round("c.z", 5) + F.lit(0.0)).alias("z"))


_SIX = "(h - (h // 43) * 43) * 6"
_Q, _T, _P = f"((v * (255 - ((s * {_SIX}) >> 8))) >> 8)", f"((v * (255 - ((s * (255 - {_SIX})) >> 8))) >> 8)", "((v * (255 - s)) >> 8)"


def _six(*c: str) -> str:
    return "CASE WHEN s = 0 THEN v " + " ".join(f"WHEN h // 43 = {i} THEN {x}" for i, x in enumerate(c[:5])) + f" ELSE {c[5]} END"


@register(f"""{RGB}, hsv AS (SELECT r AS h, g AS s, b AS v FROM rgb) SELECT h, s, v, {_six("v", _Q, _P, _P, _T, "v")} AS r, {_six(_T, "v", "v", _Q, _P, _P)} AS g, {_six(_P, _P, _T, "v", "v", _Q)} AS b FROM hsv""")
def hsv_to_rgb(spark, sf_dir):
    r, g, b = P.hsv_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return X.colours(spark, sf_dir).select(F.col("r").alias("h"), F.col("g").alias("s"), F.col("b").alias("v"), r.alias("r"), g.alias("g"), b.alias("b"))


@register(f"{PT} SELECT set_id, i, round(x / 100, 6) AS wx, round(y / 2000, 6) AS wy, round(-0.3::DOUBLE, 6) AS wz FROM pt")
def rotation_round_trip(spark, sf_dir):
    m = C.rotation_matrix(F.col("x") / 100, F.col("y") / 2000, F.lit(-0.3))
    back = C.rotation_vector(m)
    return X.points(spark, sf_dir).select("set_id", "i", *[F.round(c, 6).alias(n) for c, n in zip(back, ("wx", "wy", "wz"), strict=True)])


@register(f"""{PT}, c AS (SELECT set_id, i, (x * cos(0.1) + 1 * sin(0.1)) / 50 AS px, y / 2000 AS py, 3 - (x * sin(0.1) - 1 * cos(0.1)) / 50 AS pz FROM pt), d AS (SELECT set_id, i, px / pz AS a, py / pz AS b FROM c), q AS (SELECT *, a * a + b * b AS r2 FROM d)
SELECT set_id, i, round(500 * (a * {_LENS_SQL} + 2 * 0.01 * a * b + 0.02 * (r2 + 2 * a * a)) + 320, 5) AS u, round(480 * (b * {_LENS_SQL} + 0.01 * (r2 + 2 * b * b) + 2 * 0.02 * a * b) + 240, 5) AS v FROM q""")
def camera_projection(spark, sf_dir):
    turn = C.rotation_matrix(F.lit(0.0), F.lit(0.1), F.lit(0.0))
    u, v = C.project([F.col("x") / 50, F.col("y") / 2000, F.lit(1 / 50)], turn, (0.0, 0.0, 3.0), (500.0, 480.0), (320.0, 240.0), lens=LENS)
    return X.points(spark, sf_dir).select("set_id", "i", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"))


_H = [2.0, 0.1, 3.0, 0.5, 1.5, -2.0, 0.0001, 0.0002, 1.0]


@register(f"{PT}, k AS (SELECT set_id FROM pt GROUP BY 1 HAVING count(*) >= 6), h(i, v) AS (VALUES {', '.join(f'({i}, {v}::DOUBLE)' for i, v in enumerate(_H))}) SELECT set_id, i, round(v, 2) AS v FROM k, h")
def homography_recovered(spark, sf_dir):
    pt = X.points(spark, sf_dir)
    sets = pt.groupBy("set_id").count().where("count >= 6").select("set_id")
    u, v = P.perspective(_H, F.col("x"), F.col("y"))
    h = C.homography(pt.join(sets, "set_id").withColumn("u", u).withColumn("v", v), "set_id")
    return h.select("set_id", F.posexplode("h").alias("i", "v")).select("set_id", "i", r6(F.round("v", 2)).alias("v"))


_NINE_SQL = ", ".join(f"max(CASE WHEN y % 3 = {k // 3} AND x % 3 = {k % 3} THEN v END)::DOUBLE AS m{k}" for k in range(9))
_COFACTORS = ["m4*m8-m5*m7", "m2*m7-m1*m8", "m1*m5-m2*m4", "m5*m6-m3*m8", "m0*m8-m2*m6", "m2*m3-m0*m5", "m3*m7-m4*m6", "m1*m6-m0*m7", "m0*m4-m1*m3"]


@register(f"""{PX}, m AS (SELECT img, y // 3 AS block_y, x // 3 AS block_x, {_NINE_SQL} FROM raster GROUP BY 1, 2, 3 HAVING count(*) = 9), d AS (SELECT *, m0 * (m4*m8-m5*m7) - m1 * (m3*m8-m5*m6) + m2 * (m3*m7-m4*m6) AS det FROM m)
SELECT img, CAST(block_y AS INT) AS block_y, CAST(block_x AS INT) AS block_x, {", ".join(f"round(({c}) / nullif(det, 0), 6) + 0.0 AS r{k}" for k, c in enumerate(_COFACTORS))} FROM d""")
def matrix_inverse(spark, sf_dir):
    """Every whole 3x3 block of every image."""
    cell = lambda k: F.max(F.when((F.col("y") % 3 == k // 3) & (F.col("x") % 3 == k % 3), F.col("v").cast("double"))).alias(f"m{k}")
    block = [F.floor(F.col(c) / 3).cast("int").alias(f"block_{c}") for c in "yx"]
    m = X.raster(spark, sf_dir).groupBy("img", *block).agg(F.count(F.lit(1)).alias("n"), *[cell(k) for k in range(9)]).where("n = 9")
    inv = C.inverse_3x3([F.col(f"m{k}") for k in range(9)])
    return m.select("img", "block_y", "block_x", *[r6(inv[k]).alias(f"r{k}") for k in range(9)])


@register()
def fit_line_robust(spark, sf_dir):
    return C.fit_line_robust(X.points(spark, sf_dir), "set_id", within=5.0)


@register()
def principal_components(spark, sf_dir):
    return S.principal_components(X.vectors(spark, sf_dir), 64, 8)


@register()
def pca_projection(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    return S.project_components(v, S.principal_components(v, 64, 8), 64)


@register()
def singular_values(spark, sf_dir):
    return S.singular_values(X.raster(spark, sf_dir).select("img", F.col("y").alias("i"), F.col("x").alias("j"), "v"), "img")


# regions

_MASK = f"""{PX}, p AS (SELECT img, y, x, img * 10000 + y * 100 + x AS id FROM raster WHERE v > 150)"""
_REACH = """, e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
reach AS (SELECT id AS src, id AS dst FROM p UNION SELECT r.src, e.b FROM reach r JOIN e ON r.dst = e.a), root AS (SELECT dst AS id, min(src) AS root FROM reach GROUP BY 1),
lab AS (SELECT p.*, dense_rank() OVER (PARTITION BY img ORDER BY root) AS label FROM p JOIN root USING (id))"""
_LABELS = _MASK.replace("WITH ", "WITH RECURSIVE ", 1) + _REACH


@register(_LABELS + " SELECT img, y, x, CAST(label AS INT) AS label FROM lab")
def connected_components(spark, sf_dir):
    return R.label(X.raster(spark, sf_dir).where("v > 150"))


@register(_LABELS + """ SELECT img, CAST(label AS INT) AS label, min(x) AS "left", min(y) AS top, max(x) AS "right", max(y) AS bottom, count(*) AS area FROM lab GROUP BY 1, 2""")
def component_boxes(spark, sf_dir):
    return A.boxes(R.label(X.raster(spark, sf_dir).where("v > 150")), ["img", "label"])


@register(_LABELS + " SELECT l.img, l.y, l.x FROM lab l WHERE (l.img, l.label) IN (SELECT m.img, m.label FROM lab m JOIN raster r USING (img, y, x) WHERE r.v > 230)")
def hysteresis(spark, sf_dir):
    return R.hysteresis(X.raster(spark, sf_dir), 150, 230)


# files

@register(f"{PX} SELECT img, y AS i, x AS j, CAST(v AS DOUBLE) AS v FROM raster WHERE v > 0")
def matrix_json_round_trip(spark, sf_dir):
    cells = X.raster(spark, sf_dir).select("img", F.col("y").alias("i"), F.col("x").alias("j"), F.col("v").cast("double").alias("v"))
    return matrices.from_matrix_json(matrices.to_matrix_json(cells, ["img"])).where("v > 0")


_DENSE = f"""{PX}, g AS (SELECT img, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT img, max(y) AS my, max(x) AS mx FROM raster GROUP BY 1), (SELECT unnest(range(0, 32)) AS y), (SELECT unnest(range(0, 32)) AS x) WHERE y <= my AND x <= mx)"""


@register(f"{_DENSE} SELECT g.img, g.y, g.x, 0 AS c, coalesce(v, 0) AS v FROM g LEFT JOIN raster USING (img, y, x)")
def png_round_trip(spark, sf_dir):
    return images.decode(images.encode(X.raster(spark, sf_dir), "png"), "png")


@register(f"{_DENSE} SELECT g.img, g.y, g.x, CAST(c AS INT) AS c, coalesce(v, 0) AS v FROM g LEFT JOIN raster USING (img, y, x), (SELECT unnest(range(0, 3)) AS c)")
def bmp_round_trip(spark, sf_dir):
    return images.decode(images.encode(X.raster(spark, sf_dir), "bmp"), "bmp")
