"""Files beside images: listings, camera data of JPEG files, settings, raw frames out and in."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tessella.sources import formats

# fixed values: how files of a kind begin
_MAGIC = {"PNG": b"\x89PNG\r\n\x1a\n", "JPG": b"\xff\xd8\xff", "BMP": b"BM", "GIF": b"GIF8"}
# fixed values: tags of camera data, and the names they are given
_TAGS = {0x010F: "CameraMake", 0x0110: "CameraModel", 0x0131: "Software", 0x0102: "BitsPerSample", 0xA002: "Width", 0xA003: "Height", 0x0112: "Orientation"}
_DIRECTORY = 0x8769
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
FIELDS = tuple(_TAGS.values())


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder: path, name, extension (upper case), length, and the image format that the first bytes tell. Empty files are left out."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lit(None).cast("string")
    for k, magic in _MAGIC.items():
        kind = F.when(F.substring("content", 1, len(magic)) == F.lit(magic), k).otherwise(kind)
    return files.select("path", name.alias("name"), F.upper(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), "length", kind.alias("format"))


def _entries(tiff: bytes, at: int, order: str) -> Iterator[tuple[int, bytes | int]]:
    """Tags of a directory with text or the first whole number of their values; what lies outside the data is left out."""
    if at + 2 > len(tiff):
        return
    for i in range(struct.unpack_from(order + "H", tiff, at)[0]):
        place = at + 2 + 12 * i
        if place + 12 > len(tiff):
            return
        tag, kind, n = struct.unpack_from(order + "HHI", tiff, place)
        size = _SIZES.get(kind, 1) * n
        start = place + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, place + 8)[0]
        if start + size > len(tiff) or not n:
            continue
        if kind == 2:
            yield tag, tiff[start : start + size].split(b"\0")[0]
        elif kind in (1, 3, 4):
            yield tag, struct.unpack_from(order + {1: "B", 3: "H", 4: "I"}[kind], tiff, start)[0]


def exif(raw: bytes | None, fields: tuple[str, ...] = FIELDS) -> dict[str, str]:
    """Camera data of a JPEG file by name; none is an empty result, not an error. What isn't a JPEG file is a ValueError."""
    if raw is None or not fields:
        return {}
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, found = 2, {}
    while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] != 0xDA:
        size = struct.unpack_from(">H", raw, at + 2)[0]
        if raw[at + 1] == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
            tiff = raw[at + 10 : at + 2 + size]
            order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
            if order is None or len(tiff) < 8:
                raise ValueError("damaged camera data")
            todo = [struct.unpack_from(order + "I", tiff, 4)[0]]
            while todo:
                for tag, value in _entries(tiff, todo.pop(), order):
                    if tag == _DIRECTORY and len(found) < len(_TAGS) and _DIRECTORY not in found:
                        found[_DIRECTORY] = value
                        todo.append(value)
                    elif tag in _TAGS:
                        found.setdefault(tag, value)
            break
        at += 2 + size
    if not found:
        return {}
    out = {name: found.get(tag, b"" if tag in (0x010F, 0x0110, 0x0131) else 0) for tag, name in _TAGS.items()}
    return {k: v.decode("latin-1") if isinstance(v, bytes) else str(v) for k, v in out.items() if k in fields}


def read_exif(files: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``fields`` of JPEG files (path, content) as a map; files without camera data have an empty one."""

    def work(batches):
        for batch in batches:
            got = [list(exif(raw, fields).items()) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.map_(pa.string(), pa.string()))], ["path", "exif"])

    return files.select("path", "content").mapInArrow(work, "path string, exif map<string,string>")


class Settings:
    """Settings by section and name from a YAML text of two levels: numbers, truth values, text, and lists of them."""

    def __init__(self, text: str):
        self.sections: dict[str, dict[str, object]] = {}
        section, name = "", ""
        for line in text.splitlines():
            bare = line.split(" #")[0].rstrip()
            if not bare.strip() or bare.lstrip().startswith("#") or bare.strip() == "---":
                continue
            if bare.lstrip().startswith("- "):
                held = self.sections[section].setdefault(name, [])
                if not isinstance(held, list):
                    raise ValueError(f"{section}.{name} is no list")
                held.append(self._value(bare.lstrip()[2:]))
                continue
            name_, colon, value = bare.strip().partition(":")
            if not colon:
                raise ValueError(f"no setting: {line}")
            if not bare[0].isspace():
                section = name_.strip()
                self.sections.setdefault(section, {})
                continue
            name = name_.strip()
            self.sections[section][name] = self._value(value.strip()) if value.strip() else []

    @staticmethod
    def _value(text: str) -> object:
        text = text.strip()
        if text.startswith("[") and text.endswith("]"):
            return [Settings._value(t) for t in text[1:-1].split(",") if t.strip()]
        if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
            return text[1:-1]
        if text.lower() in ("true", "yes", "on", "false", "no", "off"):
            return text.lower() in ("true", "yes", "on")
        for kind in (int, float):
            try:
                return kind(text)
            except ValueError:
                pass
        return text

    def get(self, section: str, name: str, default):
        """The setting as the kind of ``default``; the default where there is none, ValueError where it is of another kind."""
        value = self.sections.get(section, {}).get(name, default)
        if isinstance(default, float) and type(value) is int:
            value = float(value)
        if default is not None and type(value) is not type(default):
            raise ValueError(f"{section}.{name} is not of the kind {type(default).__name__}")
        return value

    def set(self, section: str, name: str, value: object) -> None:
        self.sections.setdefault(section, {})[name] = value


class RawFrames(DataSource):
    """Sink ``raw_frames``: rows (img, content) become files ``<img>.raw`` below ``path``, in any store that pyarrow opens."""

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def writer(self, schema, overwrite):
        return _RawWriter(self.options["path"], schema.fieldNames())


class _RawWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.img, self.content = path, names.index("img"), names.index("content")

    def write(self, iterator):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        store.create_dir(root, recursive=True)
        for row in iterator:
            if row[self.content] is not None:
                # written aside and moved, so a task that runs again leaves whole files
                with store.open_output_stream(f"{root}/.{row[self.img]}.part") as f:
                    f.write(bytes(row[self.content]))
                store.move(f"{root}/.{row[self.img]}.part", f"{root}/{row[self.img]}.raw")
        return WriterCommitMessage()


def write_raw(frames: DataFrame, path: str) -> None:
    """Frames (img, content) as files without a header."""
    spark = frames.sparkSession
    spark.dataSource.register(RawFrames)
    frames.select("img", "content").write.format("raw_frames").mode("append").option("path", path).save()


def read_frames(spark: SparkSession, path: str, fmt: str, size: tuple[int, int]) -> DataFrame:
    """Files without a header as frames (path, content); rows and columns may have been made even. Other lengths fail the job."""
    h, w = size
    files = spark.read.format("binaryFile").load(path)
    exact, even = formats.frame_bytes(fmt, h, w), formats.frame_bytes(fmt, h + h % 2, w + w % 2)

    def work(batches):
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                if len(raw) != exact and len(raw) == even:
                    wide = formats.unpack(raw, fmt, h + h % 2, w + w % 2)
                    small = formats.unpack(bytes(exact), fmt, h, w)
                    raw = formats.pack({c: a[: small[c].shape[0], : small[c].shape[1]] for c, a in wide.items()}, fmt)
                out.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["path", "content"])

    fits: Column = F.col("length").isin(exact, even)
    checked = files.select("path", F.when(fits, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("wrong size: "), "path"))).alias("content"))
    return checked.mapInArrow(work, "path string, content binary")
