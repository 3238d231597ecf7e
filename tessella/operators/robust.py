"""Random sample consensus for any model: lines, parabolas, homographies, or what a caller brings along."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = np.ndarray
Fit = Callable[[np.ndarray], Model | None]
Residual = Callable[[Model, np.ndarray], np.ndarray]

#: Trials for each set.
TRIALS = 128
#: Rows that are hashed together, and the odd multiplier of the hash.
_ROWS, _ODD = 2048, np.uint64(0x9E3779B97F4A7C15)


def consensus(points: DataFrame, by: str, columns: Sequence[str], size: int, fit: Fit, residual: Residual, within: float, *, trials: int = TRIALS) -> DataFrame:
    """The points (all columns) of each set that agree with the best of ``trials`` models, and that ``model``.

    A trial's model goes through ``size`` points, each drawn by a hash of the
    row, so reruns agree; a trial that draws a point twice has no model. The model with most points within ``within``
    (strictly less) wins, the first of equals. ``fit`` takes rows of
    ``columns`` and may give None for points that no model goes through.

    Drawing and counting are aggregations that combine on the map side, so a
    set is never held in one task; a set's models are one bounded row. Rows
    with nulls take no part; sets of fewer points give no rows.
    """
    own = points.dropna(subset=[by, *columns])
    kind = points.schema[by].dataType.simpleString()

    def least(batches):
        """For each set and draw, the row of a batch with the least hash."""
        salt = (np.arange(1, trials * size + 1, dtype=np.uint64) * _ODD)[None, :]
        for whole in batches:
            for lo in range(0, len(whole), _ROWS):
                batch = whole.slice(lo, _ROWS)
                with np.errstate(over="ignore"):
                    h = (batch.column("__h").to_numpy().view(np.uint64)[:, None] ^ salt) * _ODD
                    h = ((h ^ (h >> np.uint64(29))) * _ODD) >> np.uint64(1)
                x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
                coded = batch.column(by).dictionary_encode()
                for k, name in enumerate(coded.dictionary):
                    rows = np.flatnonzero(coded.indices.to_numpy() == k)
                    first = rows[h[rows].argmin(axis=0)]
                    columns_ = [pa.array([name.as_py()] * len(first), coded.dictionary.type), pa.array(np.arange(len(first), dtype=np.int32)), pa.array(h[first, np.arange(len(first))].view(np.int64)), pa.array(x[first].tolist(), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns_, [by, "draw", "h", "p"])

    def models(batches):
        for batch in batches:
            out = []
            for drawn in batch.column(1).to_pylist():
                rows = np.array([d["p"] for d in drawn]).reshape(trials, size, len(columns))
                found = [None if len(np.unique(r, axis=0)) < size else fit(r) for r in rows]
                out.append([{"trial": t, "model": np.asarray(m, float).ravel().tolist()} for t, m in enumerate(found) if m is not None])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("trial", pa.int32()), ("model", pa.list_(pa.float64()))])))], [by, "models"])

    drawn = own.select(by, *columns, F.xxhash64(*columns).alias("__h")).mapInArrow(least, f"{by} {kind}, draw int, h long, p array<double>").groupBy(by, "draw").agg(F.min_by("p", "h").alias("p"))
    gathered = drawn.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("draw", "p"))).alias("drawn"))
    held = gathered.mapInArrow(models, f"{by} {kind}, models array<struct<trial:int,model:array<double>>>").where(F.size("models") > 0)

    def votes(batches):
        for batch in batches:
            sets, of = batch.column(by), batch.column("models").to_pylist()
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
            first = sets.dictionary_encode().indices.to_numpy()
            for k in np.unique(first).tolist():
                rows = np.flatnonzero(first == k)
                count = [(m["trial"], int((residual(np.array(m["model"]), x[rows]) < within).sum())) for m in of[rows[0]]]
                yield pa.RecordBatch.from_arrays([pa.array([sets[int(rows[0])].as_py()] * len(count), sets.type), pa.array([t for t, _ in count], pa.int32()), pa.array([n for _, n in count], pa.int64())], [by, "trial", "n"])

    counted = own.join(held, by).select(by, *columns, "models").mapInArrow(votes, f"{by} {kind}, trial int, n long").groupBy(by, "trial").agg(F.sum("n").alias("n"))
    best = counted.groupBy(by).agg(F.min_by("trial", F.struct(-F.col("n"), F.col("trial"))).alias("trial"))
    chosen = F.filter("models", lambda m: m["trial"] == F.col("trial"))[0]["model"]
    model = held.join(best, by).select(by, chosen.alias("model"))

    def agrees(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
            m = batch.column("model").to_pylist()
            near = np.array([residual(np.array(p), x[i : i + 1])[0] < within for i, p in enumerate(m)], bool)
            yield batch.filter(pa.array(near))

    joined = own.join(model, by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema)
    return joined.mapInArrow(agrees, schema)


def line_through(p: np.ndarray) -> Model | None:
    """a x + b y + c = 0 through two points, a and b of length 1 together."""
    (x0, y0), (x1, y1) = p
    a, b = y1 - y0, x0 - x1
    length = np.hypot(a, b)
    return None if length == 0 else np.array([a, b, -(a * x0 + b * y0)]) / length


def line_residual(m: Model, p: np.ndarray) -> np.ndarray:
    return np.abs(p @ m[:2] + m[2])


def parabola_through(p: np.ndarray) -> Model | None:
    """y = a x^2 + b x + c through three points."""
    m = np.vander(p[:, 0], 3)
    return None if abs(np.linalg.det(m)) < 1e-12 else np.linalg.solve(m, p[:, 1])


def parabola_residual(m: Model, p: np.ndarray) -> np.ndarray:
    return np.abs(np.polyval(m, p[:, 0]) - p[:, 1])


def homography_through(p: np.ndarray) -> Model | None:
    """The 3x3 map, row by row, that takes (x, y) to (u, v) for four pairs; None where three points of a side are in line."""
    for side in (p[:, :2], p[:, 2:]):
        for skip in range(4):
            a, b, c = np.delete(side, skip, axis=0)
            if abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) < 1e-9:
                return None
    rows = []
    for x, y, u, v in p:
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    h = np.linalg.svd(np.array(rows))[2][-1]
    return None if abs(h[8]) < 1e-12 else h / h[8]


def homography_residual(m: Model, p: np.ndarray) -> np.ndarray:
    """Distance between the mapped (x, y) and (u, v)."""
    q = np.column_stack([p[:, :2], np.ones(len(p))]) @ m.reshape(3, 3).T
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.hypot(q[:, 0] / q[:, 2] - p[:, 2], q[:, 1] / q[:, 2] - p[:, 3])
    return np.where(np.isfinite(far), far, np.inf)
