"""Mixing sources to target weights by entropy balancing.

Of all document rates that meet the sources' token targets, entropy balancing
takes those nearest to one copy each. A document with ``x`` tokens then has the
rate ``exp(x (lambda_source + mu_band))``, but never more than ``most``: its
tokens are its feature, so long and short documents of one source are tilted
differently. The multipliers ``mu`` belong to bands of length (powers of two);
they hold each band near the share of the tokens that it had, as far as the
sources' targets let them. All multipliers solve a convex dual by Newton's
method with a line search.

Rates depend on the source and the number of tokens alone, so the dual is
summed over a table of distinct (source, tokens), built once; an iteration is
two distributed aggregations of it. Rates are then rounded into whole copies by
their running sums.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import forget, listed, ship, stored, word_array

#: A source's words are taken three times at most.
MOST = 3
#: How far a band of length may leave its share: the relative change for a multiplier of 1 over the mean length.
BAND_SLACK = 0.05
#: Sources' sums of rates times tokens must come so near their targets.
NEAR = 1e-6
_ROUNDS = 100
#: Rows of (source, tokens) that one task sums.
CELL_ROWS = 200_000
#: Sums are taken in so many parts of one; what one size adds stops at a number no sum near the solution comes to.
_UNITS, _MOST = 1 << 20, 1e12
#: Lengths of a Newton step that the line search tries.
_STEPS = [0.5**i for i in range(24)]
#: Parts of a copy that running sums count in.
_PARTS = 1 << 24
#: What is left of a source's target after rounding is filled up in so many passes.
_FILLS = 3


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> dict[str | None, float]:
    """Each source's target: its share of all words by weight, at most ``most`` times its size.

    Sources in order of code points, null last, take the weights in turn. What
    a cap leaves over is shared again among the others by weight, until none is
    above its cap.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    open_, left = list(order), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in over]
    return out


class Dual:
    """The convex dual over cells of a source and a band: multipliers ``lam`` (a source each) and ``mu`` (a band each).

    ``want`` and ``bands`` are targets in units of the mean length.
    """

    def __init__(self, want: np.ndarray, bands: np.ndarray, slack: float):
        self.want, self.bands, self.slack = want, bands, slack
        self.lam, self.mu = np.zeros(len(want)), np.zeros(len(bands))

    def value(self, lam: np.ndarray, mu: np.ndarray, potential: float) -> float:
        """The dual, given the sum of all documents' potentials."""
        return potential - lam @ self.want - mu @ self.bands + self.slack / 2 * (self.bands * mu * mu).sum()

    def step(self, mass: np.ndarray, bend: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Newton's step from the sums of rate x and rate x^2 over each cell [sources, bands]; and the gradient for sources.

        Each source has its own multiplier, so the sources' block of the Hessian
        is diagonal, and what is solved has the size of the bands.
        """
        g, h = mass.sum(axis=1) - self.want, bend.sum(axis=1)
        gb = mass.sum(axis=0) - self.bands + self.slack * self.bands * self.mu
        # where all documents are at a bound, the step is left to the line search
        h = h + 1e-9 * (1 + self.want)
        ratio = bend / h[:, None]
        inner = np.diag(bend.sum(axis=0) + (self.slack + 1e-12) * self.bands + 1e-12) - bend.T @ ratio
        d_mu = -np.linalg.solve(inner, gb - ratio.T @ g)
        return -(g + bend @ d_mu) / h, d_mu, g


def _band(size: Column) -> Column:
    """floor(log2) of a length above 0."""
    return (F.length(F.bin(size)) - 1).cast("int")


def rates(cells: DataFrame, want: dict[int, float], *, most: int = MOST, slack: float = BAND_SLACK) -> tuple[dict[int, float], dict[int, float], float]:
    """The multipliers of sources and bands, and the unit of length.

    ``cells`` has ``s`` (number of the source), ``size`` (above 0) and ``n``
    (documents of that size); ``want`` the target of each source in words.
    """
    by_cell = {(r.s, r.b): r for r in cells.groupBy("s", _band(F.col("size")).alias("b")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words")).collect()}
    sources, bands = sorted({s for s, _ in by_cell}), sorted({b for _, b in by_cell})
    words = sum(r.words for r in by_cell.values())
    unit = words / sum(r.n for r in by_cell.values())
    share = sum(want[s] for s in sources) / words
    dual = Dual(np.array([want[s] / unit for s in sources]), np.array([share * sum(r.words for (_, c), r in by_cell.items() if c == b) / unit for b in bands]), slack)
    at_s, at_b = {s: i for i, s in enumerate(sources)}, {b: i for i, b in enumerate(bands)}
    cap = math.log(most)
    index_s, index_b = np.array(sources), np.array(bands)

    def sums(trials: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rate x and rate x^2 over each cell for the first trial, and all trials' potentials; sums of whole numbers, so their order doesn't matter."""

        def work(batches):
            mass, bend = np.zeros(len(sources) * len(bands)), np.zeros(len(sources) * len(bands))
            held = np.zeros(len(trials))
            for batch in batches:
                s, size, n = (batch.column(c).to_numpy() for c in ("s", "size", "n"))
                i, j, x = np.searchsorted(index_s, s), np.searchsorted(index_b, np.frexp(size.astype(float))[1] - 1), size / unit
                for t, (lam, mu) in enumerate(trials):
                    z = x * (lam[i] + mu[j])
                    rate = np.exp(np.minimum(z, cap))
                    held[t] += np.rint(np.minimum(n * np.where(z < cap, rate, most * (1 + z - cap)), _MOST) * _UNITS).sum()
                    if not t:
                        mass += np.bincount(i * len(bands) + j, np.rint(n * x * rate * _UNITS), len(mass))
                        bend += np.bincount(i * len(bands) + j, np.rint(np.where(z < cap, n * x * x * rate, 0.0) * _UNITS), len(bend))
            at, found = np.arange(2 * len(mass) + len(held)), np.concatenate([mass, bend, held])
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at[some]), pa.array(found[some])], ["at", "x"])

        out = np.zeros(2 * len(sources) * len(bands) + len(trials))
        # a few rows from each of few tasks
        for r in cells.mapInArrow(work, "at long, x double").collect():
            out[r["at"]] += r["x"] / _UNITS
        n = len(sources) * len(bands)
        return out[:n].reshape(len(sources), -1), out[n : 2 * n].reshape(len(sources), -1), out[2 * n :]

    for _ in range(_ROUNDS):
        mass, bend, now = sums([(dual.lam, dual.mu)])
        d_lam, d_mu, g = dual.step(mass, bend)
        if (np.abs(g) <= NEAR * np.maximum(dual.want, 1e-9)).all():
            break
        trials = [(dual.lam + t * d_lam, dual.mu + t * d_mu) for t in _STEPS]
        values = [dual.value(*trial, p) for trial, p in zip(trials, sums(trials)[2].tolist(), strict=True)]
        best = int(np.argmin(values))
        if not values[best] < dual.value(dual.lam, dual.mu, now[0]):
            break
        dual.lam, dual.mu = trials[best]
    return dict(zip(sources, dual.lam.tolist(), strict=True)), dict(zip(bands, dual.mu.tolist(), strict=True)), unit


def _running(df: DataFrame, value: str, by: str, *order: Column) -> DataFrame:
    """Add ``run``: the sum of ``value`` (at least 0) over the rows of ``by`` up to each row, in an order that starts with ``by``.

    Sums run inside sorted parts, spread over all tasks; what earlier parts hold
    of a ``by`` is one number for each part and ``by``.
    """
    def work(batches):
        part, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            keys, values = batch.column(by).to_numpy(), batch.column(value).to_numpy()
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sums = np.cumsum(values)
            base = np.where(new > 0, sums[new - 1], 0)
            base[0] -= total if keys[0] == last else 0
            run = sums - np.repeat(base, np.diff(np.append(new, len(keys))))
            last, total = keys[-1], int(run[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run, pa.int64()), pa.array(np.full(len(run), part, np.int32))], [*batch.schema.names, "own_run", "part"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    ship(df.sparkSession)
    out = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: work(x for x in b if len(x)), f"{schema}, own_run long, part int"), "runs")
    sums = out.groupBy(by, "part").agg(F.max("own_run").alias("all"))
    before = sums.select(by, "part", (F.sum("all").over(Window.partitionBy(by).orderBy("part")) - F.col("all")).alias("before"))
    joined = stored(out.join(before, [by, "part"]).withColumn("run", F.col("own_run") + F.col("before")).drop("own_run", "before", "part"), "runs")
    forget(out)
    return joined


def _filled(rows: DataFrame, want: list[float]) -> DataFrame:
    """Change single copies until each source's words are as near its target as one small document.

    Of the documents that could as well have been rounded the other way, and
    are no longer than what is missing (or too much), those with the least
    hashes go over. Only so many are looked at as hold about eight times that.
    """
    s, apart = F.col("s"), F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 52)).cast("double")
    for _ in range(_FILLS):
        taken = {r.s: float(r.t) for r in rows.groupBy("s").agg(F.sum(F.col("size") * F.col("copies")).alias("t")).collect()}
        missing = [want[i] - taken.get(i, want[i]) for i in range(len(want))]
        gap = listed(missing, s)
        up = gap > 0
        free = F.when(up, (F.col("part_of") > 0) & ~F.col("up")).otherwise(F.col("up")) & (F.col("size") > 0) & (F.col("size") <= F.abs(gap))
        words = {r.s: float(r.w) for r in rows.where(free).groupBy("s").agg(F.sum("size").alias("w")).collect()}
        if not words:
            break
        least = [8 * abs(missing[i]) / words[i] * (1 << 52) if i in words else None for i in range(len(want))]
        some = rows.where(free & (apart <= listed(least, s))).select("s", "size", gap.alias("gap"), apart.alias("apart"))
        run = F.sum("size").over(Window.partitionBy("s").orderBy("apart"))
        cuts = {r.s: r.c for r in some.withColumn("run", run).where(F.col("run") <= F.abs("gap")).groupBy("s").agg(F.max("apart").alias("c")).collect()}
        if not cuts:
            break
        moved = F.coalesce(free & (apart <= listed([cuts.get(i) for i in range(len(want))], s)), F.lit(False))
        changed = F.when(moved, F.when(up, 1).otherwise(-1)).otherwise(0)
        now = stored(rows.withColumn("copies", F.col("copies") + changed).withColumn("up", F.col("up") != moved), "mix")
        forget(rows)
        rows = now
    return rows


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many copies of each document the mix takes.

    Size is the number of words (null text: 0). Returns one row for each input
    row: the id, ``size``, ``source_size`` and ``target`` of its source,
    ``rate`` (the tilted rate before rounding), ``copies`` and ``taken`` =
    copies x size. Documents without words are never taken; a source without
    words has target 0. Null is a source of its own, after all others. The
    result depends only on the rows, not on their order or partitions; equal
    rows share one rate and are rounded in turn. An empty table gives no rows.

    The driver holds some numbers for each source, and for each source and band
    of length. Documents are rounded by running sums over sorted parts, so a
    source of any size is spread over all tasks.
    """
    return _mixed(docs, weights, most, id_col, text_col, source_col, None).withColumnRenamed("id", id_col)


def _mixed(docs: DataFrame, weights: tuple[int, ...], most: int, id_col: str, text_col: str, source_col: str, row: str | None) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    text = F.col(text_col)
    size = F.size(word_array(text)).cast("long")
    narrow = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(id_col), text).alias("h"), (F.col(row) if row else F.lit(0)).cast("long").alias("row")), "mix")
    sizes = {r.source: int(r["size"]) for r in narrow.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    goal = targets(sizes, weights, most)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    # one row for each source; Spark sends it along while it is small
    table = spark.createDataFrame([(i, s, sizes[s], float(goal.get(s, 0.0))) for i, s in enumerate(order)], "s int, src string, source_size long, target double")
    rows = narrow.join(table, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    want = [float(goal.get(s, 0.0)) for s in order]
    # at the cap there is nothing to solve: all documents are taken ``most`` times
    full = [float(0 < want[i] >= most * sizes[s] * (1 - 1e-9)) for i, s in enumerate(order)]
    cells = stored(rows.where("size > 0").groupBy("s", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    # few rows, so few tasks sum them in each round
    few = cells.coalesce(max(1, -(-cells.count() // CELL_ROWS)))
    left = few.where(listed(full, F.col("s")) == 0) if order else few
    lam, mu, unit = rates(left, dict(enumerate(want)), most=most) if any(not f and want[i] for i, f in enumerate(full)) else ({}, {}, 1.0)
    forget(cells)
    tilt = F.col("size") / F.lit(unit) * (listed([lam.get(i) for i in range(len(order))], F.col("s")) + listed([mu.get(b) for b in range(max(mu, default=-1) + 1)], _band(F.col("size"))))
    rate = F.when(F.col("size") == 0, 0.0).when(listed(full, F.col("s")) == 1, float(most)).otherwise(F.exp(F.least(tilt, F.lit(math.log(most)))))
    low = F.least(F.floor(F.col("rate") + 1e-9), F.lit(most))
    parted = rows.withColumn("rate", rate).withColumn("low", low).withColumn("part_of", F.when(F.col("low") < most, F.greatest(F.floor((F.col("rate") - F.col("low")) * _PARTS), F.lit(0))).otherwise(0).cast("long"))
    run = _running(parted.drop("source"), "part_of", "s", F.col("s"), F.desc("size"), F.col("h"), F.col("id"))
    forget(narrow)
    whole = lambda c: F.floor((c + _PARTS // 2) / _PARTS)
    rounded = run.withColumn("up", whole(F.col("run")) > whole(F.col("run") - F.col("part_of")))
    got = _filled(rounded.withColumn("copies", (F.col("low") + F.col("up").cast("int")).cast("int")).drop("low", "run"), want)
    copies = F.col("copies").cast("long")
    return got.select("id", *["row"] * bool(row), "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, with its own columns.

    Documents that are not taken, among them all without words, go. Rows are
    numbered in a stored copy of the table, so repeated ids do no harm.
    """
    names = docs.columns
    whole = stored(docs.select(F.struct(*names).alias("__row"), F.monotonically_increasing_id().alias("__id")), "rows")
    narrow = whole.select("__id", *[F.col(f"__row.{c}").alias(f"__{k}") for k, c in (("key", id_col), ("text", text_col), ("source", source_col))])
    copies = _mixed(narrow, weights, most, "__key", "__text", "__source", "__id").where("copies > 0").select(F.col("row").alias("__id"), "copies")
    return whole.join(copies, "__id").select("__row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")).drop("__copy")
