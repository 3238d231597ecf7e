"""Encoded images: PNG and BMP of 8-bit gray, RGB and RGBA, to and from pixel tables."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_SIGN = b"\x89PNG\r\n\x1a\n"


def encode_png(a: np.ndarray) -> bytes:
    """An array (height, width, channels) of 1, 3 or 4 channels."""
    h, w, c = a.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, w * c)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return _SIGN + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def decode_png(raw: bytes) -> np.ndarray:
    """8-bit gray, RGB and RGBA without interlacing; anything else is a ValueError."""
    if raw[:8] != _SIGN:
        raise ValueError("not a PNG file")
    at, data, head = 8, [], None
    while at + 12 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", raw, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("only 8-bit gray, RGB and RGBA without interlacing")
    w, h, c = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h + 1, w * c), np.uint8)
    for y in range(h):
        kind, line, up = int(lines[y, 0]), lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = np.cumsum(line.reshape(w, c), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            out[y + 1] = line + up
        elif kind in (3, 4):
            out[y + 1] = _by_neighbours(line.tolist(), up.tolist(), c, kind == 4)
        else:
            raise ValueError("unknown PNG filter")
    return out[1:].reshape(h, w, c)


def _by_neighbours(line: list[int], up: list[int], c: int, nearest: bool) -> list[int]:
    """Undo the filters that need the byte to the left: mean, or the nearest of three."""
    out: list[int] = []
    for i, (v, b) in enumerate(zip(line, up, strict=True)):
        a, d = (out[i - c], up[i - c]) if i >= c else (0, 0)
        guess = min((a, b, d), key=lambda k: abs(a + b - d - k)) if nearest else (a + b) >> 1
        out.append((v + guess) & 255)
    return out


def encode_bmp(a: np.ndarray) -> bytes:
    """24 bits a pixel for 1 and 3 channels, 32 for 4; lines from the bottom up."""
    h, w, c = a.shape
    rgb = np.repeat(a, 3, axis=2) if c == 1 else a
    rgb = rgb[::-1, :, [2, 1, 0] + ([3] if c == 4 else [])]
    width = rgb.shape[2] * w
    body = np.pad(rgb.reshape(h, width), ((0, 0), (0, -width % 4))).tobytes()
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, rgb.shape[2] * 8, 0, len(body), 2835, 2835, 0, 0) + body


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed 24 and 32 bits a pixel, either way up."""
    if raw[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, (_, w, h, _, bits, packed) = struct.unpack_from("<I", raw, 10)[0], struct.unpack_from("<IiiHHI", raw, 14)
    if bits not in (24, 32) or packed:
        raise ValueError("only uncompressed 24 and 32 bits a pixel")
    c = bits // 8
    line = w * c + -(w * c) % 4
    a = np.frombuffer(raw, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * c].reshape(abs(h), w, c)
    return np.ascontiguousarray((a[::-1] if h > 0 else a)[:, :, [2, 1, 0] + ([3] if c == 4 else [])])


_CODECS = {"png": (encode_png, decode_png), "bmp": (encode_bmp, decode_bmp)}


def encode(px: DataFrame, kind: str) -> DataFrame:
    """Gray pixels (img, y, x, v) as files (img, content); missing cells are 0. An image is coded in one task."""
    write = _CODECS[kind][0]

    def work(f: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(f["y"].max()) + 1, int(f["x"].max()) + 1, 1), np.uint8)
        a[f["y"], f["x"], 0] = f["v"]
        return pd.DataFrame({"img": [f["img"].iloc[0]], "content": [write(a)]})

    return px.select("img", "y", "x", "v").groupBy("img").applyInPandas(work, "img int, content binary")


def decode(files: DataFrame, kind: str) -> DataFrame:
    """Files (img, content) as pixels: img, y, x, c (channel), v. A null file has no pixels."""
    read = _CODECS[kind][1]

    def work(batches):
        for f in batches:
            for img, content in zip(f["img"], f["content"], strict=True):
                if content is not None:
                    a = read(content)
                    y, x, c = np.indices(a.shape).reshape(3, -1)
                    yield pd.DataFrame({"img": img, "y": y, "x": x, "c": c, "v": a.reshape(-1)})

    return files.select("img", "content").mapInPandas(work, "img int, y int, x int, c int, v int")
