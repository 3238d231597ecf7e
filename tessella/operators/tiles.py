"""Neighbourhoods by tiles: images are cut into squares with a margin, and each square is a NumPy array in one task.

Only pixels of the margins are sent twice, so the one shuffle carries little
more than the image, whatever the size of the neighbourhood, and an image of
any size is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a tile.
TILE = 128


class Tile:
    """The cells of a square and its margin; what isn't there is 0 in the arrays and false in ``present``."""

    def __init__(self, top: int, left: int, side: int, halo: int, present: np.ndarray, arrays: dict[str, np.ndarray]):
        self.side, self.halo, self.whole, self.arrays = side, halo, present, arrays
        self.y = (top + np.arange(side))[:, None]
        self.x = (left + np.arange(side))[None, :]

    def near(self, dy: int, dx: int, name: str = "v", margin: int = 0) -> np.ndarray:
        """For each cell of the square, widened by ``margin``, the value of the cell ``dy`` below and ``dx`` to the right."""
        return self._cut(self.arrays[name], dy, dx, margin)

    def there(self, dy: int = 0, dx: int = 0) -> np.ndarray:
        """Which of those cells exist."""
        return self._cut(self.whole, dy, dx, 0)

    def _cut(self, a: np.ndarray, dy: int, dx: int, margin: int) -> np.ndarray:
        at, n = self.halo - margin, self.side + 2 * margin
        return a[at + dy : at + dy + n, at + dx : at + dx + n]

    def frame(self, size: tuple[int, int], ry: int, rx: int) -> np.ndarray:
        """Cells less than ``ry`` rows or ``rx`` columns from the border of an image of ``size`` (height, width)."""
        h, w = size
        return (self.y < ry) | (self.y >= h - ry) | (self.x < rx) | (self.x >= w - rx)


def over_tiles(px: DataFrame, halo: int, work: Callable[[Tile], tuple[np.ndarray, dict[str, np.ndarray]]], out: str, values: Sequence[str] = ("v",), tile: int = TILE) -> DataFrame:
    """Run ``work`` on every tile of pixels (img, y, x and ``values``).

    ``work`` says which cells of the square are put out, and gives the columns
    ``out`` as arrays over the square. A cell should have one row; of several,
    any one counts.
    """
    kinds = {v: np.float64 if px.schema[v].dataType.simpleString() in ("double", "float") else np.int64 for v in values}
    key = px.schema["img"].dataType.simpleString()

    def spread(c: str):
        low, high = F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int")
        return F.explode(F.sequence(low, high))

    def one(k, table):
        img, ty, tx = (x.as_py() for x in k)
        top, left, side = ty * tile, tx * tile, tile + 2 * halo
        y, x = (table.column(c).to_numpy().astype(np.int64) - at + halo for c, at in (("y", top), ("x", left)))
        present = np.zeros((side, side), bool)
        present[y, x] = True
        arrays = {}
        for v, kind in kinds.items():
            arrays[v] = np.zeros((side, side), kind)
            arrays[v][y, x] = table.column(v).to_numpy()
        keep, columns = work(Tile(top, left, tile, halo, present, arrays))
        at_y, at_x = np.nonzero(keep)
        place = {"img": pa.array([img] * len(at_y), table.schema.field("img").type), "y": pa.array((at_y + top).astype(np.int32)), "x": pa.array((at_x + left).astype(np.int32))}
        return pa.table(place | {name: pa.array(a[at_y, at_x]) for name, a in columns.items()})

    cells = px.where("img IS NOT NULL").select("img", "y", "x", *values).withColumn("ty", spread("y")).withColumn("tx", spread("x"))
    return cells.groupBy("img", "ty", "tx").applyInArrow(one, f"img {key}, y int, x int, {out}")
