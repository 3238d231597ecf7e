"""Array-shaped inputs derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-bit images as pixels (img, y, x, v): one image for each line number; cells without lines are missing."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_linenumber").cast("int").alias("img"), (F.col("l_orderkey") % SIDE).cast("int").alias("y"), (F.col("l_partkey") % SIDE).cast("int").alias("x"))
        .agg((F.sum(F.col("l_quantity").cast("long")) * 7 % 256).cast("int").alias("v"))
    )


RASTER_SQL = """raster AS (SELECT CAST(l_linenumber AS INT) AS img, CAST(l_orderkey % 32 AS INT) AS y, CAST(l_partkey % 32 AS INT) AS x,
  CAST(sum(CAST(l_quantity AS BIGINT)) * 7 % 256 AS INT) AS v FROM lineitem GROUP BY 1, 2, 3)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")


VECTORS_SQL = "vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point sets (set_id, i, x, y), one for each brand."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))


POINTS_SQL = "pt AS (SELECT p_brand AS set_id, p_partkey AS i, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part)"


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct 8-bit colours (r, g, b)."""
    c = lambda k: (F.col(k) % 256).cast("int")
    return table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("r"), c("l_suppkey").alias("g"), c("l_orderkey").alias("b")).distinct()


COLOURS_SQL = "rgb AS (SELECT DISTINCT CAST(l_partkey % 256 AS INT) AS r, CAST(l_suppkey % 256 AS INT) AS g, CAST(l_orderkey % 256 AS INT) AS b FROM lineitem)"
