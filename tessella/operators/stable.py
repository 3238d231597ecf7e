"""Maximally stable extremal regions: regions that keep their size while a threshold moves.

Pixels are taken from dark to bright and joined with neighbours that are in
already; regions of one level that merge become children of what they merge
into. The order is sequential inside an image, so an image is one task's work;
images are what is spread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_FOUR = ((0, 1), (-1, 0), (0, -1), (1, 0))
_EIGHT = (*_FOUR, (-1, -1), (-1, 1), (1, -1), (1, 1))


class Tree:
    """All regions of an image: ``level``, ``area``, ``parent`` (-1 for the last), and the region in which each pixel first is."""

    def __init__(self, a: np.ndarray, eight: bool = True):
        h, w = a.shape
        flat = a.ravel()
        order = np.argsort(flat, kind="stable").tolist()
        grey = flat.tolist()
        joined = [-1] * (h * w)  # union-find over pixels
        node = [-1] * (h * w)  # the region of each set's root
        self.level: list[int] = []
        self.area: list[int] = []
        self.parent: list[int] = []
        first = [-1] * (h * w)

        def find(i: int) -> int:
            while joined[i] != i:
                joined[i] = joined[joined[i]]
                i = joined[i]
            return i

        for p in order:
            y, x = divmod(p, w)
            own, g = len(self.level), grey[p]
            joined[p], node[p], first[p] = p, own, own
            self.level.append(g)
            self.area.append(1)
            self.parent.append(-1)
            root = p
            for dy, dx in _EIGHT if eight else _FOUR:
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    q = p + dy * w + dx
                    if joined[q] < 0:
                        continue
                    q = find(q)
                    if q == root:
                        continue
                    # regions of this level are one; darker ones become children
                    m, n = node[root], node[q]
                    self.area[m] += self.area[n]
                    self.parent[n] = m
                    joined[q] = root
        # a region that has a parent of its own level is that parent
        n = len(self.level)
        same = list(range(n))
        for i in range(n - 1, -1, -1):
            p = self.parent[i]
            if p >= 0 and self.level[p] == self.level[i]:
                same[i] = same[p]
        keep = [i for i in range(n) if same[i] == i]
        number = {i: k for k, i in enumerate(keep)}
        self.pixel = np.array([number[same[i]] for i in first], np.int64)
        up = [self.parent[i] for i in keep]
        self.parent = [-1 if p < 0 else number[same[p]] for p in up]
        self.level, self.area = [self.level[i] for i in keep], [self.area[i] for i in keep]


def stable_regions(tree: Tree, delta: int, least: float, most: float, variation: float, diversity: float) -> list[tuple[int, float]]:
    """The stable regions of a tree and their variations, larger regions' parents first.

    A region's variation is how much larger it is ``delta`` levels on, as a
    share of its size. It is stable if that is at most ``variation``, not above
    its parent's, below that of one of its children (if there are any), and the
    size lies between ``least`` and ``most`` pixels. Of stable regions whose
    sizes differ by less than ``diversity``, the one that varies least stays.
    """
    n = len(tree.level)
    change = [0.0] * n
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        p = i
        while tree.parent[p] >= 0 and tree.level[tree.parent[p]] <= tree.level[i] + delta:
            p = tree.parent[p]
        change[i] = (tree.area[p] - tree.area[i]) / tree.area[i]
        if tree.parent[i] >= 0:
            children[tree.parent[i]].append(i)
    stable = [False] * n
    for i in range(n):
        p = tree.parent[i]
        ok = (p < 0 or change[p] >= change[i]) and change[i] <= variation and least <= tree.area[i] <= most
        stable[i] = ok and (not children[i] or any(change[i] < change[c] for c in children[i]))
    out = []
    nearest = lambda x: int(x + 0.5)
    todo = [i for i in range(n) if tree.parent[i] < 0]
    while todo:
        i = todo.pop()
        if stable[i]:
            limit, p = nearest(tree.area[i] / (1 - diversity)), tree.parent[i]
            while stable[i] and p >= 0 and tree.area[p] < limit:
                stable[i] = not stable[p] or change[p] > change[i]
                p = tree.parent[p]
            below, small = list(children[i]), nearest(tree.area[i] * (1 - diversity))
            while stable[i] and below:
                c = below.pop()
                if tree.area[c] > small:
                    stable[i] = not (stable[c] and change[c] < change[i])
                    below += children[c]
            if stable[i]:
                out.append((i, change[i]))
        todo += children[i]
    return out


def regions(px: DataFrame, size: tuple[int, int], *, delta: int = 2, least: float = 0.0055 * 0.0055, most: float = 0.12, variation: float = 0.3, diversity: float = 0.2, eight: bool = True) -> DataFrame:
    """Stable dark regions of images of one size: img, region (1.. by level, size and first pixel), level, area, variation, left, top, right, bottom, m10, m01.

    ``least`` and ``most`` are shares of the image. Missing cells count 0. For
    bright regions, give 255 - v.
    """
    h, w = size
    kind = px.schema["img"].dataType.simpleString()

    def one(key, table):
        a = np.zeros((h, w), np.int64)
        y, x, v = (table.column(c).to_numpy() for c in "yxv")
        a[y, x] = v
        tree = Tree(a, eight)
        rows = []
        parent = np.array(tree.parent, np.int64)
        for i, change in stable_regions(tree, delta, least * h * w, most * h * w, variation, diversity):
            inside = np.zeros(len(parent) + 1, bool)
            inside[i] = True
            # a region comes before its parent
            for k in range(i - 1, -1, -1):
                inside[k] = inside[parent[k]]
            at = np.flatnonzero(inside[tree.pixel])
            py, qx = at // w, at % w
            rows.append((tree.level[i], tree.area[i], change, int(qx.min()), int(py.min()), int(qx.max()), int(py.max()), int(qx.sum()), int(py.sum()), int(at[0])))
        rows.sort(key=lambda r: (r[0], r[1], r[-1]))
        names = ["level", "area", "variation", "left", "top", "right", "bottom", "m10", "m01"]
        types = [pa.int32(), pa.int64(), pa.float64(), *[pa.int32()] * 4, pa.int64(), pa.int64()]
        columns = {c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(names, types, strict=True))}
        return pa.table({"img": pa.array([key[0].as_py()] * len(rows), table.schema.field("img").type), "region": pa.array(range(1, len(rows) + 1), pa.int32())} | columns)

    return px.select("img", "y", "x", "v").groupBy("img").applyInArrow(one, f"img {kind}, region int, level int, area long, variation double, left int, top int, right int, bottom int, m10 long, m01 long")
