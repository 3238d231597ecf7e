"""Matrices and raw images in and out of files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATRIX = "struct<rows:int,cols:int,type:string,data:array<double>>"


def to_matrix_json(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells (i, j, v) of each group as one JSON document, row by row; a missing cell is 0.

    A matrix becomes one row, so its size is bounded by a task's memory.
    """
    kinds = {c: cells.schema[c].dataType.simpleString() for c in by}

    def one(key, table):
        i, j, v = (table.column(c).to_numpy() for c in "ijv")
        a = np.zeros((int(i.max()) + 1, int(j.max()) + 1))
        a[i, j] = v
        names = {c: pa.array([k.as_py()], table.schema.field(c).type) for c, k in zip(by, key, strict=True)}
        return pa.table(names | {"rows": pa.array([a.shape[0]], pa.int32()), "cols": pa.array([a.shape[1]], pa.int32()), "data": pa.array([a.ravel()], pa.list_(pa.float64()))})

    held = cells.select(*by, "i", "j", F.col("v").cast("double").alias("v")).groupBy(*by).applyInArrow(one, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", rows int, cols int, data array<double>")
    return held.select(*by, F.to_json(F.struct("rows", "cols", F.lit("64f").alias("type"), "data")).alias("json"))


def from_matrix_json(docs: DataFrame, json: str = "json") -> DataFrame:
    """The cells (i, j, v) of JSON matrices, beside the other columns; malformed documents give none."""
    m = docs.withColumn("m", F.from_json(json, MATRIX))
    cells = m.select(*[c for c in docs.columns if c != json], F.col("m.cols").alias("cols"), F.posexplode("m.data").alias("k", "v"))
    return cells.select(*[c for c in docs.columns if c != json], F.expr("cast(k div cols as int)").alias("i"), (F.col("k") % F.col("cols")).cast("int").alias("j"), "v")


def read_raw(spark: SparkSession, path: str, width: int, height: int, channels: int = 1) -> DataFrame:
    """Pixels (path, y, x, c, v) of headerless 8-bit images with interleaved channels; files of another size are refused."""
    files = spark.read.format("binaryFile").load(path)
    fits = F.col("length") == width * height * channels
    checked = files.select("path", F.when(fits, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("wrong size: "), "path"))).alias("content"))

    def work(batches):
        y, x, c = (pa.array(a.ravel()) for a in np.indices((height, width, channels), np.int32))
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(y)), y, x, c, pa.array(np.frombuffer(raw, np.uint8).astype(np.int32))], ["path", "y", "x", "c", "v"])

    return checked.mapInArrow(work, "path string, y int, x int, c int, v int")


def read_xml_strings(docs: DataFrame, xml: str, xpath: str) -> DataFrame:
    """Texts at ``xpath`` of XML documents, as an array column ``strings``."""
    return docs.withColumn("strings", F.xpath(F.col(xml), F.lit(xpath)))


def read_xml_numbers(docs: DataFrame, xml: str, xpath: str) -> DataFrame:
    """Numbers at ``xpath`` of XML documents, as an array column ``numbers``."""
    return docs.withColumn("numbers", F.transform(F.xpath(F.col(xml), F.lit(xpath)), lambda s: s.cast("double")))
