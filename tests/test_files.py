"""Listings, camera data, settings and raw frames."""

import struct

import pyarrow as pa
import pytest
from pyspark.sql.types import StructType
from tessella.plans import catalogue, golden
from tessella.sources import files, formats, images
import numpy as np


def jpeg(entries, order="<"):
    """A JPEG file with camera data: entries are (tag, kind, value)."""
    n = len(entries)
    body, extra, at = b"", b"", 8 + 2 + 12 * n + 4
    for tag, kind, value in entries:
        if kind == 2:
            raw = value.encode() + b"\0"
            place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(extra))
            extra += raw if len(raw) > 4 else b""
            body += struct.pack(order + "HHI", tag, kind, len(raw)) + place
        else:
            body += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "H", value) + b"\0\0" if kind == 3 else struct.pack(order + "I", value))
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", n) + body + b"\0\0\0\0" + extra
    app = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xda\x00\x02\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_camera_data(order):
    raw = jpeg([(0x010F, 2, "A maker"), (0x0110, 2, "M1"), (0x0112, 3, 6), (0x0102, 3, 8)], order)
    got = files.exif(raw)
    assert got == {"CameraMake": "A maker", "CameraModel": "M1", "Software": "", "BitsPerSample": "8", "Width": "0", "Height": "0", "Orientation": "6"}
    assert files.exif(raw, ("Orientation",)) == {"Orientation": "6"} and files.exif(raw, ()) == {}
    assert files.exif(b"\xff\xd8\xff\xda\x00\x02") == {} and files.exif(None) == {}
    with pytest.raises(ValueError):
        files.exif(b"not a file")
    for cut in range(6, len(raw)):
        try:
            files.exif(raw[:cut])
        except ValueError:
            pass


def test_listing_and_camera_data_of_files(spark, tmp_path):
    (tmp_path / "a.JPG").write_bytes(jpeg([(0x0112, 3, 3)]))
    (tmp_path / "b.png").write_bytes(images.encode_png(np.zeros((2, 2, 1), np.uint8)))
    (tmp_path / "c").write_bytes(b"plain")
    got = {r.name: (r.extension, r.length > 0, r.format) for r in files.listing(spark, str(tmp_path)).collect()}
    assert got == {"a.JPG": ("JPG", True, "JPG"), "b.png": ("PNG", True, "PNG"), "c": ("", True, None)}
    one = spark.read.format("binaryFile").load(f"{tmp_path}/a.JPG")
    assert files.read_exif(one).first().exif["Orientation"] == "3"


def test_settings():
    s = files.Settings("---\n# all\ndetector:\n  threshold: 20\n  ratio: 0.8\n  on: yes\n  name: 'fast'\n  sizes: [1, 2.5]\n  names:\n    - a\n    - b\nempty:\n")
    assert s.get("detector", "threshold", 0) == 20 and s.get("detector", "threshold", 0.0) == 20.0
    assert s.get("detector", "ratio", 1.0) == 0.8 and s.get("detector", "on", False) is True
    assert s.get("detector", "name", "") == "fast" and s.get("detector", "sizes", []) == [1, 2.5] and s.get("detector", "names", []) == ["a", "b"]
    assert s.get("none", "x", 7) == 7 and s.get("detector", "x", "d") == "d"
    s.set("empty", "k", 3)
    assert s.get("empty", "k", 0) == 3
    with pytest.raises(ValueError):
        s.get("detector", "name", 1)
    with pytest.raises(ValueError):
        files.Settings("what is this")


@pytest.mark.parametrize("fmt", ["rgb24", "nv12"])
def test_raw_frames_round_trip(spark, tmp_path, fmt):
    given = golden.frames(spark, fmt)
    files.write_raw(given, str(tmp_path / "raw"))
    back = files.read_frames(spark, str(tmp_path / "raw" / "*.raw"), fmt, golden.FRAME)
    assert sorted(bytes(r.content) for r in back.collect()) == sorted(bytes(r.content) for r in given.collect())
    # frames whose rows and columns were made even
    h, w = golden.FRAME
    files.write_raw(golden.frames(spark, fmt, (h + h % 2, w + w % 2)), str(tmp_path / "even"))
    even = files.read_frames(spark, str(tmp_path / "even" / "*.raw"), fmt, golden.FRAME)
    assert sorted(bytes(r.content) for r in even.collect()) == sorted(bytes(r.content) for r in given.collect())
    with pytest.raises(Exception, match="wrong size"):
        files.read_frames(spark, str(tmp_path / "raw" / "*.raw"), fmt, (5, 5)).collect()


def test_conversions_that_do_not_exist():
    for src, dst in (("y", "yuv444p"), ("hsv", "rgb24"), ("rgb24", "nv12"), ("y", "hsv")):
        with pytest.raises(ValueError):
            formats.convert_frame(bytes(formats.frame_bytes(src, 4, 4)), src, dst, 4, 4)
    with pytest.raises(ValueError):
        formats.unpack(b"123", "rgb24", 1, 2)


@pytest.mark.parametrize("fmt", ["rgba32", "rgb565be", "yuv420p", "nv21", "yuyv422"])
def test_frames_with_long_rows(fmt):
    r = np.random.default_rng(1)
    raw = r.integers(0, 256, formats.frame_bytes(fmt, 4, 10), np.uint8).tobytes()
    narrow = formats.wrap_frame(raw, fmt, 4, 6, 10)
    assert len(narrow) == formats.frame_bytes(fmt, 4, 6)
    assert (formats.unpack(narrow, fmt, 4, 6)["y" if "y" in formats.unpack(narrow, fmt, 4, 6) else "r"] == formats.unpack(raw, fmt, 4, 10)["y" if "y" in formats.unpack(raw, fmt, 4, 10) else "r"][:, :6]).all()
    assert formats.wrap_frame(formats.wrap_frame(raw, fmt, 4, 10, 10, 16), fmt, 4, 10, 16) == raw


@pytest.mark.parametrize("name", ["convert_bgr24_y", "convert_yvu420p_rgb24"])
def test_few_small_frames_take_one_task(spark, name):
    # each task holds three Python workers here; no table is read, so the folder need not exist
    df = catalogue.QUERIES[name](spark, "/nowhere")
    assert df.rdd.getNumPartitions() == 1
    assert {r.img for r in df.select("img").distinct().collect()} == set(range(golden.IMAGES))


def test_large_frames_are_dealt_over_tasks(spark):
    assert golden.frames(spark, "rgb24", (1080, 1920), 8).rdd.getNumPartitions() == 8
    some = golden.frames(spark, "y", (1000, 1100), 9)
    assert some.rdd.getNumPartitions() == 3
    assert sorted((r.img, len(r.content)) for r in some.collect()) == [(i, 1_100_000) for i in range(9)]
    assert golden.frames(spark, "y", images=0).collect() == []


def test_conversions_hold_few_frames(monkeypatch):
    class Frames:
        """Stands for a table; keeps what a worker would run."""

        schema = StructType().add("img", "integer").add("content", "binary")
        select = lambda self, *_: self
        mapInArrow = lambda self, work, _: work

    h, w, calls, convert_frame = 1000, 1100, [], formats.convert_frame
    monkeypatch.setattr(formats, "convert_frame", lambda *a: calls.append(1) or convert_frame(*a))
    raw = bytes(formats.frame_bytes("yvu420p", h, w))
    contents = [raw, None, raw, raw, raw, raw, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int32()), pa.array(contents, pa.binary())], ["img", "content"])
    for work in (formats.convert(Frames(), "yvu420p", "rgb24", (h, w)), formats.scale_to_rgb(Frames(), "yvu420p", (h, w), (h, w))):
        calls.clear()
        got = work(iter([batch, batch.slice(0, 0)]))
        first = next(got)
        assert len(calls) == 2 and first.num_rows == 3
        table = pa.Table.from_batches([first, *got])
        assert table["img"].to_pylist() == list(range(7))
        assert table["content"].to_pylist() == [c and convert_frame(c, "yvu420p", "rgb24", h, w) for c in contents]
