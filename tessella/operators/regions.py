"""Connected regions of binary images, by tiles that are joined along their borders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.tiles import TILE


class _Sets:
    """Union-find in which the smallest member stands for a set."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)


def regions_of(mask: np.ndarray) -> np.ndarray:
    """The number of each set cell's 8-connected region, -1 elsewhere; runs of a row are joined with those they touch above."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    sets = _Sets(len(y))
    starts = np.searchsorted(y, np.arange(mask.shape[0] + 1)).tolist()
    low, high = first.tolist(), last.tolist()
    for row in range(1, mask.shape[0]):
        above, to = starts[row - 1], starts[row]
        for run in range(starts[row], starts[row + 1]):
            while above < to and high[above] < low[run] - 1:
                above += 1
            at = above
            while at < to and low[at] <= high[run] + 1:
                sets.join(at, run)
                at += 1
    out = np.full(mask.shape, -1, np.int64)
    roots = np.array([sets.find(i) for i in range(len(y))], np.int64)
    out[mask] = np.repeat(roots, last - first + 1)
    return out


def _local(mask: DataFrame, tile: int) -> DataFrame:
    """Each set pixel with the first pixel (ry, rx) of its region inside the tile; and pixels of the margin that such a region touches (``link``)."""
    key = mask.schema["img"].dataType.simpleString()

    def one(k, table):
        img, ty, tx = (x.as_py() for x in k)
        top, left, side = ty * tile - 1, tx * tile - 1, tile + 2
        y, x = (table.column(c).to_numpy().astype(np.int64) - at for c, at in (("y", top), ("x", left)))
        cells = np.zeros((side, side), bool)
        cells[y, x] = True
        region = regions_of(cells)
        inner = np.zeros((side, side), bool)
        inner[1:-1, 1:-1] = cells[1:-1, 1:-1]
        place = np.flatnonzero(inner)
        of = region.ravel()[place]
        # places come in order, so the first of each region is its first pixel
        names, at = np.unique(of, return_index=True)
        first = dict(zip(names.tolist(), place[at].tolist(), strict=True))
        there = np.flatnonzero(cells)
        there = there[[r in first for r in region.ravel()[there].tolist()]] if len(there) else there
        root = np.array([first[r] for r in region.ravel()[there].tolist()], np.int64)
        out = [there // side + top, there % side + left, root // side + top, root % side + left]
        columns = [pa.array([img] * len(there), table.schema.field("img").type), *(pa.array(c.astype(np.int32)) for c in out), pa.array(~inner.ravel()[there])]
        return pa.table(dict(zip(("img", "y", "x", "ry", "rx", "link"), columns, strict=True)))

    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / tile).cast("int"), F.floor((F.col(c) + 1) / tile).cast("int")))
    cells = mask.where("img IS NOT NULL").select("img", "y", "x").withColumn("ty", spread("y")).withColumn("tx", spread("x"))
    return cells.groupBy("img", "ty", "tx").applyInArrow(one, f"img {key}, y int, x int, ry int, rx int, link boolean")


def _merged(links: DataFrame) -> DataFrame:
    """Regions (ay, ax) of an image that are linked with others, and the first pixel (ty, tx) of all that hang together."""
    key = links.schema["img"].dataType.simpleString()

    def one(k, table):
        a, b = (table.column(f"{s}y").to_numpy().astype(np.int64) << 32 | table.column(f"{s}x").to_numpy().astype(np.int64) for s in "ab")
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        sets = _Sets(len(names))
        for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            sets.join(i, j)
        top = names[[sets.find(i) for i in range(len(names))]]
        halves = [names >> 32, names & 0xFFFFFFFF, top >> 32, top & 0xFFFFFFFF]
        return pa.table({"img": pa.array([k[0].as_py()] * len(names), table.schema.field("img").type)} | {c: pa.array(h.astype(np.int32)) for c, h in zip(("ry", "rx", "ty", "tx"), halves, strict=True)})

    return links.groupBy("img").applyInArrow(one, f"img {key}, ry int, rx int, ty int, tx int")


def label(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """8-connected regions of set pixels: label 1.. in each image, in order of first pixels (rows, then columns, from 0 on).

    Tiles are labelled alone. Where a region touches a pixel of the next tile,
    the two tiles' regions are linked; an image's links, a row for each pair of
    regions that meet at a border, are what one task holds.
    """
    local = _local(mask, tile)
    own = local.where("NOT link").drop("link")
    touched = local.where("link").select("img", "y", "x", F.col("ry").alias("ay"), F.col("rx").alias("ax"))
    links = touched.join(own.select("img", "y", "x", F.col("ry").alias("by"), F.col("rx").alias("bx")), ["img", "y", "x"]).where("ay <> by OR ax <> bx").select("img", "ay", "ax", "by", "bx").distinct()
    joined = own.join(_merged(links), ["img", "ry", "rx"], "left").select("img", "y", "x", F.coalesce("ty", "ry").alias("ry"), F.coalesce("tx", "rx").alias("rx"))
    roots = joined.select("img", "ry", "rx").distinct().withColumn("label", F.row_number().over(Window.partitionBy("img").orderBy("ry", "rx")))
    return joined.join(roots, ["img", "ry", "rx"]).select("img", "y", "x", "label")


def keep_labels(labelled: DataFrame, wanted) -> DataFrame:
    """Pixels of regions for which an aggregate condition over the region's rows holds; all others go."""
    kept = labelled.groupBy("img", "label").agg(wanted.alias("__keep")).where("__keep").select("img", "label")
    return labelled.join(kept, ["img", "label"], "left_semi").select("img", "y", "x", "label")


def hysteresis(px: DataFrame, low: int, high: int) -> DataFrame:
    """Pixels above ``low`` in regions that have one above ``high``."""
    weak = px.where(F.col("v") > low)
    labelled = label(weak)
    strong = labelled.join(px.where(F.col("v") > high).select("img", "y", "x"), ["img", "y", "x"]).select("img", "label").distinct()
    return labelled.join(strong, ["img", "label"]).select("img", "y", "x")
