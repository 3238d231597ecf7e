"""Frames of raw pixels: how formats lay out their channels, and conversions between formats.

A frame is a row (img, content); all frames of a table have one size (height,
width). Frames are converted one by one inside their task; no pixel becomes a
row unless ``split`` is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Channels of a pixel, in order of bytes.
PACKED = {"y": "y", "rgb24": "rgb", "bgr24": "bgr", "rgba32": "rgba", "argb32": "argb", "bgra32": "bgra", "hsv": "hsv"}
#: 5, 6 and 5 bits from the high end, and the order of the two bytes.
SHORT = {"rgb565le": ("rgb", "<u2"), "rgb565be": ("rgb", ">u2"), "bgr565le": ("bgr", "<u2"), "bgr565be": ("bgr", ">u2")}
#: Planes in order, and how many pixels a row and a column of chroma stand for.
PLANAR = {"yuv420p": ("yuv", 2, 2), "yvu420p": ("yvu", 2, 2), "yuv422p": ("yuv", 1, 2), "yuv444p": ("yuv", 1, 1)}
#: A plane of luma, then one of chroma pairs for each 2x2 pixels.
SEMI = {"nv12": "uv", "nv21": "vu"}
#: Bytes of two neighbours in a row, which share their chroma.
PAIRED = {"yuyv422": "yuyv", "uyvy422": "uyvy"}
FORMATS = (*PACKED, *SHORT, *PLANAR, *SEMI, *PAIRED)
#: What a frame can be converted to.
TARGETS = ("y", "yuv444p", "rgb24", "bgr24", "rgba32", "bgra32", "hsv")

#: Bytes of new frames that a task gathers before it puts them out.
HELD = 1 << 22

Channels = dict[str, np.ndarray]


def _steps(fmt: str) -> tuple[int, int]:
    """Rows and columns of pixels for one of chroma."""
    if fmt in PLANAR:
        return PLANAR[fmt][1:]
    return (2, 2) if fmt in SEMI else (1, 2) if fmt in PAIRED else (1, 1)


def frame_bytes(fmt: str, h: int, w: int) -> int:
    """How long a frame is; rows and columns of chroma are rounded up."""
    sy, sx = _steps(fmt)
    if fmt in PACKED:
        return h * w * len(PACKED[fmt])
    if fmt in SHORT:
        return 2 * h * w
    if fmt in PAIRED:
        return 4 * h * -(-w // 2)
    return h * w + 2 * (-(-h // sy) * -(-w // sx))


def unpack(raw: bytes, fmt: str, h: int, w: int) -> Channels:
    """The channels of a frame, each as it is stored; a frame of another length is a ValueError."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    if len(raw) != frame_bytes(fmt, h, w):
        raise ValueError(f"{len(raw)} bytes are no {fmt} frame of {h} x {w}")
    a = np.frombuffer(raw, np.uint8)
    if fmt in PACKED:
        names = PACKED[fmt]
        return {c: a.reshape(h, w, len(names))[:, :, i] for i, c in enumerate(names)}
    if fmt in SHORT:
        names, kind = SHORT[fmt]
        k = np.frombuffer(raw, kind).astype(np.int32).reshape(h, w)
        high, green, low = (k & 0xF800) >> 8, (k & 0x07E0) >> 3, (k & 0x001F) << 3
        wide = (high | high >> 5, green | green >> 6, low | low >> 5)
        return {c: v.astype(np.uint8) for c, v in zip(names, wide, strict=True)}
    sy, sx = _steps(fmt)
    ch, cw = -(-h // sy), -(-w // sx)
    if fmt in PLANAR:
        out, at = {}, 0
        for c in PLANAR[fmt][0]:
            shape = (h, w) if c == "y" else (ch, cw)
            out[c] = a[at : at + shape[0] * shape[1]].reshape(shape)
            at += shape[0] * shape[1]
        return out
    if fmt in SEMI:
        pairs = a[h * w :].reshape(ch, cw, 2)
        return {"y": a[: h * w].reshape(h, w)} | {c: pairs[:, :, i] for i, c in enumerate(SEMI[fmt])}
    fours, order = a.reshape(h, cw, 4), PAIRED[fmt]
    luma = [i for i, c in enumerate(order) if c == "y"]
    return {"y": fours[:, :, luma].reshape(h, 2 * cw)[:, :w], "u": fours[:, :, order.index("u")], "v": fours[:, :, order.index("v")]}


def pack(channels: Channels, fmt: str) -> bytes:
    """The inverse of ``unpack``; 5 and 6 bits keep the high ones, a missing alpha is 255."""
    if fmt in PACKED:
        some = next(iter(channels.values()))
        return np.stack([channels[c] if c in channels else np.full(some.shape, 255) for c in PACKED[fmt]], axis=2).astype(np.uint8).tobytes()
    if fmt in SHORT:
        names, kind = SHORT[fmt]
        high, green, low = (channels[c].astype(np.int32) for c in names)
        return (high >> 3 << 11 | green >> 2 << 5 | low >> 3).astype(kind).tobytes()
    if fmt in PLANAR:
        return b"".join(channels[c].astype(np.uint8).tobytes() for c in PLANAR[fmt][0])
    if fmt in SEMI:
        return channels["y"].astype(np.uint8).tobytes() + np.stack([channels[c] for c in SEMI[fmt]], axis=2).astype(np.uint8).tobytes()
    y, order = channels["y"], PAIRED[fmt]
    pairs = np.pad(y, ((0, 0), (0, y.shape[1] % 2)), mode="edge").reshape(y.shape[0], -1, 2)
    luma = iter((pairs[:, :, 0], pairs[:, :, 1]))
    return np.stack([next(luma) if c == "y" else channels[c] for c in order], axis=2).astype(np.uint8).tobytes()


# fixed values: integer colour transforms
def _yuv(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> Channels:
    r, g, b = (c.astype(np.int32) for c in (r, g, b))
    cut = lambda c: np.clip(c, 0, 255)
    return {"y": cut((33 * r + 65 * g + 13 * b >> 7) + 16), "u": cut((-38 * r - 74 * g + 112 * b >> 8) + 128), "v": cut((112 * r - 94 * g - 18 * b >> 8) + 128)}


def _rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> Channels:
    """Chroma is centred at 127, luma at 16."""
    y, u, v = y.astype(np.int32) - 16, u.astype(np.int32) - 127, v.astype(np.int32) - 127
    cut = lambda c: np.clip(c >> 5, 0, 255)
    return {"r": cut(37 * y + 51 * v), "g": cut(37 * y - 13 * u - 26 * v), "b": cut(37 * y + 65 * u)}


def _hsv(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> Channels:
    """Hue with 43 for a sixth of a turn, wrapping at 256; quotients are single-precision products with a reciprocal, rounded away from zero at halves."""
    r, g, b = (c.astype(np.int32) for c in (r, g, b))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = top - low

    def scaled(a: np.ndarray, full: float, by: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a.astype(np.float32) * (np.float32(full) * (1.0 / by).astype(np.float32))
        x = np.where(by == 0, 0, x).astype(np.float64)
        return np.where(x >= 0, np.floor(x + 0.5), -np.floor(0.5 - x)).astype(np.int32)

    # fixed values: a sixth of a turn is 43, a third 85, two thirds 171
    h = np.where(top == r, scaled(g - b, 43, span), np.where(top == g, 85 + scaled(b - r, 43, span), 171 + scaled(r - g, 43, span)))
    return {"h": h % 256, "s": scaled(span, 255, top), "v": top}


def convert_frame(raw: bytes, src: str, dst: str, h: int, w: int) -> bytes:
    """One frame in another format; what isn't in ``TARGETS``, or can't be reached, is a ValueError."""
    if dst not in TARGETS:
        raise ValueError(f"no conversion to {dst}")
    channels = unpack(raw, src, h, w)
    if src == dst:
        return raw
    if set("rgb") <= set(channels):
        rgb = [channels[c] for c in "rgb"]
        if dst in ("y", "yuv444p"):
            return pack(_yuv(*rgb), dst)
        return pack(_hsv(*rgb) if dst == "hsv" else channels if "a" in PACKED[dst] and "a" in channels else dict(zip("rgb", rgb, strict=True)), dst)
    if "h" in channels or dst == "hsv" and "u" not in channels:
        raise ValueError(f"no conversion from {src} to {dst}")
    if dst == "y":
        return pack({"y": channels["y"]}, dst)
    if "u" not in channels:
        gray = channels["y"]
        if dst == "yuv444p":
            raise ValueError(f"no conversion from {src} to {dst}")
        return pack({"r": gray, "g": gray, "b": gray}, dst)
    sy, sx = _steps(src)
    wide = {c: channels[c].repeat(sy, axis=0).repeat(sx, axis=1)[:h, :w] for c in "uv"}
    if dst == "yuv444p":
        return pack({"y": channels["y"], **wide}, dst)
    rgb = _rgb(channels["y"], wide["u"], wide["v"])
    return pack(_hsv(*(rgb[c] for c in "rgb")) if dst == "hsv" else rgb, dst)


def _each(batches: Iterator[pa.RecordBatch], one: Callable[[bytes], bytes]) -> Iterator[pa.RecordBatch]:
    """Frames made anew one by one and put out as soon as there are ``HELD`` bytes of them; null stays null."""
    for batch in batches:
        out, held, first = [], 0, 0
        for i, raw in enumerate(batch.column(1)):
            out.append(one(raw.as_py()) if raw.is_valid else None)
            held += len(out[-1] or b"")
            if held >= HELD or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(out)), pa.array(out, pa.binary())], ["img", "content"])
                out, held, first = [], 0, i + 1


def convert(frames: DataFrame, src: str, dst: str, size: tuple[int, int]) -> DataFrame:
    """Frames (img, content) in another format; null stays null, and a frame of a wrong length fails the job."""

    def work(batches):
        yield from _each(batches, lambda raw: convert_frame(raw, src, dst, *size))

    kind = frames.schema["img"].dataType.simpleString()
    return frames.select("img", "content").mapInArrow(work, f"img {kind}, content binary")


def scale_plane(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear scaling of a plane in 8.8 fixed point, clamped at the far border."""
    fy, fx = np.arange(h) * (a.shape[0] * 256 // h), np.arange(w) * (a.shape[1] * 256 // w)
    y, x = fy >> 8, fx >> 8
    y1, x1 = np.minimum(y + 1, a.shape[0] - 1), np.minimum(x + 1, a.shape[1] - 1)
    wy, wx = (fy & 255)[:, None], (fx & 255)[None, :]
    b = a.astype(np.int64)
    top = b[y][:, x] * (256 - wx) + b[y][:, x1] * wx
    low = b[y1][:, x] * (256 - wx) + b[y1][:, x1] * wx
    return (top * (256 - wy) + low * wy >> 16).astype(np.uint8)


def scale_to_rgb(frames: DataFrame, src: str, size: tuple[int, int], to_size: tuple[int, int]) -> DataFrame:
    """Frames of a format with luma and chroma as RGB of another size: each plane is scaled, then converted."""
    if src not in (*PLANAR, *SEMI, *PAIRED):
        raise ValueError(f"{src} has no luma and chroma")
    sy, sx = _steps(src)

    def one(raw: bytes) -> bytes:
        if size == to_size:
            return convert_frame(raw, src, "rgb24", *size)
        h, w = to_size
        channels = unpack(raw, src, *size)
        chroma = {c: scale_plane(channels[c], -(-h // sy), -(-w // sx)).repeat(sy, axis=0).repeat(sx, axis=1)[:h, :w] for c in "uv"}
        return pack(_rgb(scale_plane(channels["y"], h, w), chroma["u"], chroma["v"]), "rgb24")

    def work(batches):
        yield from _each(batches, one)

    kind = frames.schema["img"].dataType.simpleString()
    return frames.select("img", "content").mapInArrow(work, f"img {kind}, content binary")


def wrap_frame(raw: bytes, fmt: str, h: int, w: int, stride: int, to_stride: int | None = None) -> bytes:
    """A frame whose rows are ``stride`` pixels long as one with rows of ``to_stride`` (the width, if not given); what is added is 0."""
    to_stride = to_stride or w
    wide = unpack(raw, fmt, h, stride)
    out = {}
    for c, a in wide.items():
        n = -(-w // (stride // a.shape[1] if a.shape[1] < stride else 1)) if a.shape[1] < stride else w
        full = -(-to_stride // 2) if a.shape[1] < stride else to_stride
        out[c] = np.pad(a[:, : min(n, full)], ((0, 0), (0, max(0, full - n))))
    return pack(out, fmt)


def split(frames: DataFrame, fmt: str, size: tuple[int, int]) -> DataFrame:
    """The channels of frames as rows (img, c, y, x, v), each channel as it is stored; ``c`` is its letter."""

    def work(batches):
        for batch in batches:
            for img, raw in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if raw is None:
                    continue
                for c, a in unpack(raw, fmt, *size).items():
                    y, x = np.indices(a.shape, np.int32).reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([pa.array([img.as_py()] * a.size, img.type), pa.array([c] * a.size), pa.array(y), pa.array(x), pa.array(a.reshape(-1).astype(np.int32))], ["img", "c", "y", "x", "v"])

    kind = frames.schema["img"].dataType.simpleString()
    return frames.select("img", "content").mapInArrow(work, f"img {kind}, c string, y int, x int, v int")


def merge(cells: DataFrame, fmt: str, size: tuple[int, int]) -> DataFrame:
    """The inverse of ``split``: frames (img, content) from the rows of their channels; a missing cell is 0. A frame is put together in one task."""
    empty = unpack(bytes(frame_bytes(fmt, *size)), fmt, *size)

    def one(key, table):
        channels = {c: np.zeros(a.shape, np.uint8) for c, a in empty.items()}
        names = np.array(table.column("c").to_pylist())
        y, x, v = (table.column(c).to_numpy() for c in "yxv")
        for c, a in channels.items():
            own = names == c
            a[y[own], x[own]] = v[own]
        return pa.table({"img": pa.array([key[0].as_py()], table.schema.field("img").type), "content": pa.array([pack(channels, fmt)], pa.binary())})

    kind = cells.schema["img"].dataType.simpleString()
    return cells.select("img", "c", "y", "x", "v").groupBy("img").applyInArrow(one, f"img {kind}, content binary")
