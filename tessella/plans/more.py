"""Queries of descriptors, warps, ranks, digests and casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import pixel as P
from tessella.operators import aggregates as A
from tessella.operators import corners as C
from tessella.operators import matching as M
from tessella.operators import neighbourhood as N
from tessella.operators import regions as R
from tessella.operators import stable
from tessella.plans import golden
from tessella.plans.catalogue import _DIFF_SQL, _LABELS, PT, PX, SIZE, VEC, _RING_SQL, r6, register
from tessella.sources import fixtures as X
from tessella.sources import formats

_THETA = f"""{_DIFF_SQL}, d AS (SELECT img, y, x, sqrt((gx * gx + gy * gy)::DOUBLE) AS m, fmod(degrees(atan2(gy::DOUBLE, gx::DOUBLE)) + 360.0, 360.0) AS full_turn FROM g),
t AS (SELECT *, CASE WHEN full_turn > 180 THEN full_turn - 180 ELSE full_turn END AS theta FROM d), f AS (SELECT *, CAST(trunc(theta / 20 - 0.5) AS INT) AS b0 FROM t),
a AS (SELECT *, (theta - b0 * 20) / 20 - 0.5 AS apart FROM f), n AS (SELECT *, b0 + CASE WHEN apart >= 0 THEN 1 ELSE -1 END AS b1 FROM a),
v AS (SELECT img, y // 8 AS cy, x // 8 AS cx, b0 AS bin, m - abs(m * apart) AS w FROM n UNION ALL SELECT img, y // 8, x // 8, CASE WHEN b1 < 0 THEN 8 WHEN b1 > 8 THEN 0 ELSE b1 END, abs(m * apart) FROM n),
h AS (SELECT img, CAST(cy AS INT) AS cy, CAST(cx AS INT) AS cx, CAST(bin AS INT) AS bin, sum(w) AS weight FROM v GROUP BY 1, 2, 3, 4)"""


def _histograms(spark, sf_dir):
    return N.hog_histograms(X.raster(spark, sf_dir), SIZE)


@register(f"{_THETA} SELECT img, cy, cx, bin, round(weight, 4) AS weight FROM h")
def hog_histograms(spark, sf_dir):
    return _histograms(spark, sf_dir).select("img", "cy", "cx", "bin", F.round("weight", 4).alias("weight"))


_BLOCK_SQL = """, b AS (SELECT img, cy - dy AS by_, cx - dx AS bx, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, bin, weight AS v FROM h, (SELECT unnest(range(0, 2)) AS dy), (SELECT unnest(range(0, 2)) AS dx) WHERE cy - dy BETWEEN 0 AND 2 AND cx - dx BETWEEN 0 AND 2)"""
_L2 = "sqrt(sum({0} * {0}) OVER (PARTITION BY img, by_, bx) + 1e-12)"
_NORM_SQL = {
    "none": "SELECT *, v AS o FROM b", "l1": "SELECT *, v / (sum(v) OVER (PARTITION BY img, by_, bx) + 1e-6) AS o FROM b", "l1sqrt": "SELECT *, sqrt(v / (sum(v) OVER (PARTITION BY img, by_, bx) + 1e-6)) AS o FROM b",
    "l2": f"SELECT *, v / {_L2.format('v')} AS o FROM b", "l2hys": f"SELECT *, c / {_L2.format('c')} AS o FROM (SELECT *, least(v / {_L2.format('v')}, 0.2) AS c FROM b)",
}


def _blocks(norm: str) -> None:
    def f(spark, sf_dir):
        b = N.hog_blocks(_histograms(spark, sf_dir), (4, 4), 2, norm)
        return b.select("img", F.col("by").cast("int").alias("block_y"), F.col("bx").cast("int").alias("block_x"), "dy", "dx", "bin", F.round("value", 5).alias("value"))

    f.__name__ = f"hog_blocks_{norm}"
    register(f"{_THETA}{_BLOCK_SQL}, o AS ({_NORM_SQL[norm]}) SELECT img, CAST(by_ AS INT) AS block_y, CAST(bx AS INT) AS block_x, dy, dx, bin, round(o, 5) AS value FROM o")(f)


for _norm in N.HOG_NORMS:
    _blocks(_norm)


@register(f"""{PX}, ring(k, dy, dx) AS (VALUES {_RING_SQL}), d AS (SELECT a.img, a.y, a.x, list(b.v - a.v ORDER BY k) AS d FROM raster a, ring JOIN raster b ON b.y = a.y + dy AND b.x = a.x + dx AND b.img = a.img GROUP BY 1, 2, 3 HAVING count(*) = 16),
s AS (SELECT img, y, x, s, list_concat(d, d)[s : s + 11] AS arc FROM d, (SELECT unnest(range(1, 17)) AS s)), m AS (SELECT img, y, x, max(greatest(list_min(arc), -list_max(arc))) AS m FROM s GROUP BY 1, 2, 3)
SELECT img, y, x, CAST(m - 1 AS INT) AS strength, CAST(row_number() OVER (PARTITION BY img ORDER BY m DESC, y, x) AS INT) AS place FROM m WHERE m > 10 QUALIFY row_number() OVER (PARTITION BY img ORDER BY m DESC, y, x) <= 20""")
def strongest_corners(spark, sf_dir):
    """FAST with arcs of 12, the 20 strongest of each image by place."""
    corners = N.fast_corners(X.raster(spark, sf_dir), 10, 12)
    return M.by_strength(M.retain_best(corners, 20, "img", "strength", "y", "x"), "img", "strength", "y", "x")


@register(f"""{PX}, ring(k, dy, dx) AS (VALUES {_RING_SQL}), d AS (SELECT a.img, a.y, a.x, list(b.v - a.v ORDER BY k) AS d FROM raster a, ring JOIN raster b ON b.y = a.y + dy AND b.x = a.x + dx AND b.img = a.img GROUP BY 1, 2, 3 HAVING count(*) = 16),
s AS (SELECT img, y, x, s, list_concat(d, d)[s : s + 8] AS arc FROM d, (SELECT unnest(range(1, 17)) AS s)), m AS (SELECT img, y, x, max(greatest(list_min(arc), -list_max(arc))) - 1 AS m FROM s GROUP BY 1, 2, 3 HAVING max(greatest(list_min(arc), -list_max(arc))) > 20),
p AS (SELECT a.img, a.y, a.x, any_value(a.m) AS m FROM m a LEFT JOIN m b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY 1, 2, 3 HAVING coalesce(max(b.m), -1) < any_value(a.m)),
q AS (SELECT * FROM p QUALIFY rank() OVER (PARTITION BY img ORDER BY m DESC) <= 12), k AS (SELECT * FROM q WHERE y BETWEEN 6 AND 25 AND x BETWEEN 6 AND 25)
SELECT k.img, 0 AS level, k.y, k.x, CAST(any_value(k.m) AS INT) AS strength, round(fmod(degrees(atan2(sum(b.v * (b.y - k.y))::DOUBLE, sum(b.v * (b.x - k.x))::DOUBLE)) + 360.0, 360.0), 6) + 0.0 AS angle, k.y::DOUBLE AS y0, k.x::DOUBLE AS x0
FROM k JOIN raster b ON k.img = b.img AND (k.y - b.y) * (k.y - b.y) + (k.x - b.x) * (k.x - b.x) <= 9 GROUP BY k.img, k.y, k.x""")
def oriented_corners(spark, sf_dir):
    return C.detect(X.raster(spark, sf_dir), SIZE, wanted=12, levels=1, patch=7).withColumn("angle", r6(F.col("angle")))


@register()
def corner_descriptors(spark, sf_dir):
    px = X.raster(spark, sf_dir)
    found = C.detect(px, SIZE, wanted=24, levels=2, patch=7)
    return C.describe(px, found, SIZE, levels=2, pairs=C.pattern(128, 3)).select("img", "level", "y", "x", F.hex("bits").alias("bits"))


@register()
def stable_regions(spark, sf_dir):
    return stable.regions(X.raster(spark, sf_dir), SIZE, least=0.002, variation=1.0).withColumn("variation", F.round("variation", 6))


_W = [0.9, 0.2, 1.5, -0.1, 1.1, -2.0, 0.002, 0.003, 1.0]
_WARP_SQL = f"""{PX}, o AS (SELECT i.img, CAST(yy AS INT) AS y, CAST(xx AS INT) AS x FROM (SELECT DISTINCT img FROM raster) i, (SELECT unnest(range(0, 30)) AS yy), (SELECT unnest(range(0, 34)) AS xx)),
z AS (SELECT *, {_W[6]}::DOUBLE * x + {_W[7]}::DOUBLE * y + {_W[8]}::DOUBLE AS z FROM o), m AS (SELECT img, y, x, ({_W[0]}::DOUBLE * x + {_W[1]}::DOUBLE * y + {_W[2]}::DOUBLE) / z AS sx, ({_W[3]}::DOUBLE * x + {_W[4]}::DOUBLE * y + {_W[5]}::DOUBLE) / z AS sy FROM z)"""


@register(f"{_WARP_SQL} SELECT m.img, m.y, m.x, coalesce(r.v, 7) AS v FROM m LEFT JOIN raster r ON r.img = m.img AND r.y = floor(sy + 0.5) AND r.x = floor(sx + 0.5)")
def warp_perspective_nearest(spark, sf_dir):
    return N.warp(X.raster(spark, sf_dir), _W, SIZE, (30, 34), mode="nearest", default=7)


@register(f"""{_WARP_SQL}, n AS (SELECT *, CAST(floor(sy) AS INT) AS iy, CAST(floor(sx) AS INT) AS ix FROM m),
c AS (SELECT n.*, least(iy + a, 31) AS cy, least(ix + b, 31) AS cx, (CASE WHEN a = 1 THEN sy - iy ELSE 1 - sy + iy END) * (CASE WHEN b = 1 THEN sx - ix ELSE 1 - sx + ix END) AS w FROM n, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(a, b))
SELECT c.img, c.y, c.x, CASE WHEN any_value(sy) BETWEEN 0 AND 31 AND any_value(sx) BETWEEN 0 AND 31 THEN CAST(floor(round(sum(w * coalesce(v, 0)), 6)) AS INT) ELSE 7 END AS v FROM c LEFT JOIN raster r ON r.img = c.img AND r.y = c.cy AND r.x = c.cx GROUP BY 1, 2, 3""")
def warp_perspective(spark, sf_dir):
    return N.warp(X.raster(spark, sf_dir), _W, SIZE, (30, 34), default=7)


@register(f"""{PX}, e AS (SELECT i.img, yy, xx, coalesce(v, 0) AS v FROM (SELECT DISTINCT img FROM raster) i CROSS JOIN (SELECT unnest(range(0, 32)) AS yy) CROSS JOIN (SELECT unnest(range(0, 32)) AS xx) LEFT JOIN raster r ON r.img = i.img AND r.y = yy AND r.x = xx)
SELECT img, md5(unhex(string_agg(lpad(lower(to_hex(v)), 2, '0'), '' ORDER BY yy, xx))) AS md5 FROM e GROUP BY 1""")
def image_md5(spark, sf_dir):
    return A.digests(X.raster(spark, sf_dir), SIZE)


@register(_LABELS + " SELECT img, y, x, CAST(label AS INT) AS label FROM lab QUALIFY count(*) OVER (PARTITION BY img, label) >= 4")
def large_components(spark, sf_dir):
    return R.keep_labels(R.label(X.raster(spark, sf_dir).where("v > 150")), F.count(F.lit(1)) >= 4)


@register(f"""{PT}, m AS (SELECT set_id, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM (SELECT * FROM pt UNION ALL SELECT 'line ' || set_id, i, x, 3 * x + 1 FROM pt) GROUP BY 1) SELECT set_id, xx * yy - xy * xy <= 1e-9 * (xx + yy) * (xx + yy) AS colinear FROM m""")
def colinear_sets(spark, sf_dir):
    pt = X.points(spark, sf_dir)
    lines = pt.select(F.concat(F.lit("line "), "set_id").alias("set_id"), "i", "x", (F.col("x") * 3 + 1).alias("y"))
    return A.colinear(pt.unionByName(lines), "set_id")


@register(f"""{VEC}, e AS (SELECT vec_id, unnest(e) * 40000 AS a, generate_subscripts(e, 1) - 1 AS i FROM vec) SELECT vec_id, CAST(i AS INT) AS i, CAST(least(greatest(trunc(a), 0), 255) AS BIGINT) AS u8, CAST(least(greatest(trunc(a), -32768), 32767) AS BIGINT) AS i16, CAST(trunc(a) AS BIGINT) AS i64, CAST(a AS FLOAT)::DOUBLE AS f32 FROM e""")
def casts(spark, sf_dir):
    a = F.col("a") * 40000
    e = X.vectors(spark, sf_dir).select("vec_id", F.posexplode("e").alias("i", "a"))
    return e.select("vec_id", "i", P.saturated(a, 0, 255).cast("long").alias("u8"), P.saturated(a, -32768, 32767).cast("long").alias("i16"), a.cast("long").alias("i64"), a.cast("float").cast("double").alias("f32"))


def _scaled_sql() -> str:
    """Planes of an NV12 frame, each scaled in 8.8 fixed point, chroma shared by 2x2 pixels, then converted."""
    (h, w), (oh, ow) = golden.FRAME, (24, 40)
    out, at = [], {"y": (h, w, oh, ow), "u": (-(-h // 2), -(-w // 2), oh // 2, ow // 2)}
    for name, rule in (("y", "y"), ("u", "u"), ("v", "v")):
        ph, pw, th, tw = at["y" if name == "y" else "u"]
        cell = lambda y, x, rule=rule: f"({golden._place(rule, y, x)})"
        y0, x0 = f"((y * {ph * 256 // th}) >> 8)", f"((x * {pw * 256 // tw}) >> 8)"
        y1, x1 = f"least({y0} + 1, {ph - 1})", f"least({x0} + 1, {pw - 1})"
        wy, wx = f"((y * {ph * 256 // th}) & 255)", f"((x * {pw * 256 // tw}) & 255)"
        top = f"({cell(y0, x0)} * (256 - {wx}) + {cell(y0, x1)} * {wx})"
        low = f"({cell(y1, x0)} * (256 - {wx}) + {cell(y1, x1)} * {wx})"
        out.append(f"{name}_ AS (SELECT img, y, x, (({top} * (256 - {wy}) + {low} * {wy}) >> 16) AS v FROM (SELECT unnest(range(0, {golden.IMAGES})) AS img), (SELECT unnest(range(0, {th})) AS y), (SELECT unnest(range(0, {tw})) AS x))")
    planes = ", ".join(out)
    rgb = " UNION ALL ".join(f"SELECT CAST(img AS INT) AS img, '{c}' AS c, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {e} AS v FROM s" for c, e in golden._TO_RGB.items())
    return f"WITH {planes}, s AS (SELECT y_.img, y_.y, y_.x, y_.v AS a, u_.v AS b, v_.v AS c FROM y_ JOIN u_ ON u_.img = y_.img AND u_.y = y_.y // 2 AND u_.x = y_.x // 2 JOIN v_ ON v_.img = y_.img AND v_.y = y_.y // 2 AND v_.x = y_.x // 2) {rgb}"


@register(_scaled_sql())
def scale_nv12_to_rgb(spark, sf_dir):
    return formats.split(formats.scale_to_rgb(golden.frames(spark, "nv12"), "nv12", golden.FRAME, (24, 40)), "rgb24", (24, 40))

