"""Sources and sinks that no query of the catalogue reads: raw images, XML, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.operators import camera, neighbourhood
from tessella.sources import matrices
from tessella.streaming import frames


def test_raw_images(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 256, (5, 7, 3), np.uint8)
    (tmp_path / "a.raw").write_bytes(a.tobytes())
    got = matrices.read_raw(spark, f"{tmp_path}/*.raw", 7, 5, 3).collect()
    assert len(got) == a.size and all(r.v == a[r.y, r.x, r.c] for r in got)
    with pytest.raises(Exception, match="wrong size"):
        matrices.read_raw(spark, f"{tmp_path}/*.raw", 7, 5, 1).collect()


def test_xml_arrays(spark):
    docs = spark.createDataFrame([("<a><v>1.5</v><v>-2</v><s>x</s><s>y z</s></a>",), ("<a/>",), (None,)], "xml string")
    got = matrices.read_xml_strings(matrices.read_xml_numbers(docs, "xml", "a/v/text()"), "xml", "a/s/text()").collect()
    assert [(r.numbers, r.strings) for r in got] == [([1.5, -2.0], ["x", "y z"]), ([], []), (None, None)]


def test_frames_of_a_stream(spark, tmp_path):
    """Each file of frames is a batch; the operator's output of each lies in its own folder, and nothing is read twice."""
    schema = "img int, y int, x int, v int"
    rows = lambda img: [(img, y, x, (y * 3 + x + img) % 7) for y in range(6) for x in range(6)]
    for img in (1, 2):
        spark.createDataFrame(rows(img), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    given = frames.read_frames(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    for _ in range(2):
        frames.process(given, lambda px: neighbourhood.morph(px, "erode"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("img", "y", "x", "v")
    want = neighbourhood.morph(spark.createDataFrame(rows(1) + rows(2), schema), "erode")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("img", "y", "x", "v").collect()))


def test_transfer_error(spark):
    pairs = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0), ("a", 0.0, 0.0, 1.0, 1.0)], "set_id string, x double, y double, u double, v double")
    h = [1.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0]
    assert camera.transfer_error(pairs, "set_id", h).first().mse == pytest.approx((1 + 1 + 0 + 0) / 2)


def test_matrices_as_json_of_any_size(spark):
    cells = spark.range(90 * 70).select(F.lit("m").alias("name"), (F.col("id") / 70).cast("int").alias("i"), (F.col("id") % 70).cast("int").alias("j"), (F.col("id") * 0.1).alias("v"))
    back = matrices.from_matrix_json(matrices.to_matrix_json(cells, ["name"]))
    assert back.count() == 6300 and back.join(cells.withColumnRenamed("v", "w"), ["name", "i", "j"]).where("v <> w").count() == 0
