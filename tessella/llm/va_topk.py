"""Exact top-k inner products with vector-approximation files.

The cell file holds one byte for each component of each distinct vector: which
of 256 equal cells between the component's least and greatest value it lies in.
It is built once and kept; queries scan it instead of the vectors. A query's
contribution of a cell's middle is linear in the number of the cell, so the
middle scores of a block are one product of single precision with the bytes,
and what a cell's width can add or take away is one number for each query.

Vectors whose upper bound is below the k-th greatest lower bound are out. Of
the others, exact vectors are read in the order of their upper bounds: first
those of the ``2 k`` greatest, then, while an upper bound is not below the k-th
exact score, the rest.

Equal vectors are one entry of the file, with their smallest ids, so a vector
that is very common is bounded and read once. Queries go out in waves of
bounded size; each wave's results are written before the next begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import forget, shared_dir, ship, sized, stored

#: Cells of a dimension.
CELLS = 256
#: Vectors in a block of the cell file.
BLOCK = 4096
#: Queries of a wave, about: with 64 dimensions, 8 MB are sent to each executor.
WAVE = 16_384
#: Queries that are multiplied with a block together.
_TOGETHER = 512
#: Vectors that set the first scores to beat; they only save work.
SEEDS = 4096
#: Candidates that a task holds for each query, about, before it drops those that are out.
_HELD = 64
_EXACT = 2.0**53


def integers(column: pa.Array, scale: float = 1024.0) -> list[np.ndarray | None]:
    """floor(scale * x), x as double, for each vector; None where a component is null or not finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        flat = np.where(np.isfinite(flat), np.floor(flat * scale), np.nan)
    out: list[np.ndarray | None] = []
    for i in range(len(column)):
        v = flat[offsets[i] : offsets[i + 1]]
        out.append(v if valid[i] and np.isfinite(v).all() else None)
    return out


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of rows with rows, integers held as doubles; beyond 63 bits they stop at the last number."""
    most = np.abs(q).max(initial=0.0) * np.abs(v).max(initial=0.0) * q.shape[1]
    if most < _EXACT:
        return np.rint((q * v).sum(axis=1)).astype(np.int64)
    wide = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, v, strict=True)]
    return np.array([max(min(s, 2**63 - 1), -(2**63)) for s in wide], np.int64)


@dataclass(frozen=True)
class Marks:
    """Where the cells of each dimension begin, and how wide they are, for vectors of one length."""

    low: np.ndarray
    width: np.ndarray

    def cells(self, v: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor((v - self.low) / self.width), CELLS - 1).astype(np.uint8)


class Wave:
    """Queries of one length, ready to be held against blocks of cells."""

    def __init__(self, number: np.ndarray, vectors: np.ndarray, beat: np.ndarray, marks: Marks):
        self.number, self.vectors, self.beat = number, vectors, beat
        with np.errstate(over="ignore", invalid="ignore"):
            slope = vectors * marks.width
            #: A cell spans its width less 1, as components are whole numbers; sums of products are rounded, and that is added.
            self.reach = (np.abs(vectors) * np.maximum(marks.width - 1, 0)).sum(axis=1) / 2
            self.base = (vectors * (marks.low + np.maximum(marks.width - 1, 0) / 2)).sum(axis=1)
            size = np.abs(slope).sum(axis=1) * CELLS + (np.abs(vectors) * (np.abs(marks.low) + marks.width)).sum(axis=1)
            self.reach = self.reach + size * (len(marks.low) + 8) * 2.0**-23 + 1
            self.slope = slope.astype(np.float32)
        self.bad = ~np.isfinite(self.slope).all(axis=1) | ~np.isfinite(self.base + self.reach) | (size > 2.0**100)


class Scanner:
    """Holds blocks of cells against a wave: what may be among the k best of each query, by bounds alone."""

    def __init__(self, wave: Wave, k: int):
        self.wave, self.k, self.beat = wave, k, wave.beat.copy()
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n_held, self.limit = 0, _HELD * len(wave.beat)

    def add(self, entries: np.ndarray, cells: np.ndarray) -> None:
        wave, c = self.wave, cells.T.astype(np.float32)
        for lo in range(0, len(self.beat), _TOGETHER):
            part = slice(lo, lo + _TOGETHER)
            with np.errstate(invalid="ignore", over="ignore"):
                middle = wave.slope[part] @ c + wave.base[part, None]
                hope = (middle + wave.reach[part, None] >= self.beat[part, None]) | wave.bad[part, None]
            q, at = np.nonzero(hope)
            m, q = middle[q, at], q + lo
            bad = wave.bad[q]
            self.held.append((q, entries[at], np.where(bad, -np.inf, m - wave.reach[q]), np.where(bad, np.inf, m + wave.reach[q])))
            self.n_held += len(q)
        if self.n_held > self.limit:
            self._prune()
            self.limit = max(self.limit, 2 * self.n_held)

    def _prune(self) -> None:
        """Raise what is to beat to the k-th lower bound and drop what is below; one more counts, as a query isn't its own answer."""
        q, entry, low, high = (np.concatenate(x) for x in zip(*self.held, strict=True))
        if len(q):
            order = np.lexsort((-low, q))
            first = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1]))
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            kth = order[place == self.k]
            self.beat[q[kth]] = np.maximum(self.beat[q[kth]], low[kth])
        keep = high >= self.beat[q]
        self.held, self.n_held = [(q[keep], entry[keep], low[keep], high[keep])], int(keep.sum())

    def found(self) -> tuple[np.ndarray, ...]:
        """Query, entry, lower and upper bound."""
        if self.held:
            self._prune()
            return self.held[0]
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors kept as bytes, by their length: which rows, and the rows as a matrix."""
    raw = column.to_pylist()
    sizes = np.array([len(x) // 8 for x in raw], np.int64)
    out = {}
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        out[d] = rows, np.frombuffer(b"".join([raw[i] for i in rows.tolist()]), "<f8").reshape(len(rows), d)
    return out


def _prepared(vectors: DataFrame, is_query: Column, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: ``row`` (a number), ``id``, ``q`` (is a query), ``v`` (components as bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, BLOCK):
            whole = integers(batch.column("v"), scale)
            some = pa.array([i for i, v in enumerate(whole) if v is not None], pa.int64())
            raw = pa.array([(v + 0.0).astype("<f8").tobytes() for v in whole if v is not None], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(some) for c in ("row", "id", "q")), raw], ["row", "id", "q", "v"])

    known = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    slim = known.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    numbered = slim.select(F.monotonically_increasing_id().alias("row"), "id", "q", "v")
    return stored(numbered.mapInArrow(work, "row long, id long, q boolean, v binary"), "vectors")


def _marks(distinct: DataFrame) -> dict[int, Marks]:
    """The marks of each length of vectors: the driver gets two numbers for each dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for d, (_, m) in _matrix(batch.column(0)).items():
                low, high = ends.get(d, (m[0], m[0]))
                ends[d] = np.minimum(low, m.min(axis=0)), np.maximum(high, m.max(axis=0))
        for d, (low, high) in ends.items():
            if d:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(low), pa.array(high)], ["d", "i", "low", "high"])

    got = distinct.select("v").mapInArrow(work, "d int, i int, low double, high double").groupBy("d", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    by: dict[int, list] = {}
    for r in sorted(got.collect(), key=lambda r: (r.d, r.i)):
        by.setdefault(r.d, []).append(r)
    out = {0: Marks(np.zeros(0), np.ones(0))}
    for d, rows in by.items():
        low, high = np.array([r.low for r in rows]), np.array([r.high for r in rows])
        out[d] = Marks(low, np.maximum(np.ceil((high - low + 1) / CELLS), 1.0))
    return out


def _cell_file(distinct: DataFrame, marks: dict[int, Marks]) -> DataFrame:
    """The cell file: a row for each block, with the numbers of its entries and their cells."""
    sent = distinct.sparkSession.sparkContext.broadcast(marks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, BLOCK):
            entry = batch.column("entry").to_numpy()
            found = _matrix(batch.column("v"))
            columns = [pa.array(list(found), pa.int32()), pa.array([entry[rows].astype("<i8").tobytes() for rows, _ in found.values()], pa.binary()), pa.array([sent.value[d].cells(m).tobytes() for d, (_, m) in found.items()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["d", "entries", "cells"])

    return stored(distinct.select("entry", "v").mapInArrow(work, "d int, entries binary, cells binary"), "cells")


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", wave: int = WAVE, reads: list[tuple[int, int]] | None = None) -> DataFrame:
    """The ``k`` vectors of highest inner product for every query vector, exactly.

    Components become floor(scale * x). Queries are the rows for which the
    column ``is_query`` is true; candidates are all rows but the query's own
    with as many components. Ties go to the smaller id. Rows with a null id, or
    whose vector is null or has a null or non-finite component, take no part; a
    query with fewer than ``k`` candidates gets them all. Repeated rows are
    separate candidates, and separate queries. Returns ``query_id``, ``rank``
    from 1, ``vec_id`` and ``score``. Other columns are not read.

    ``reads``, if given, gets for each wave how many pairs of a query and an
    entry of the cell file there were, and how many exact vectors were read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = _prepared(vectors, is_query, scale, id_col, vector_col)
    # of equal vectors the k + 1 smallest ids can matter: one of them may be the query's own
    first = Window.partitionBy("v").orderBy("id", "row")
    few = rows.select("v", "id", "row").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    grouped = few.groupBy("v").agg(F.collect_list(F.struct("id", "row")).alias("members"))
    distinct = stored(grouped.select(F.monotonically_increasing_id().alias("entry"), "v", "members"), "distinct")
    marks = _marks(distinct)
    cells = _cell_file(distinct, marks)
    some = [np.frombuffer(r.v, "<f8") for r in distinct.select("v").limit(SEEDS).collect()]
    asked = rows.where("q")
    waves = max(1, -(-asked.count() // wave))
    out = shared_dir(spark, "top")
    result = "query_id long, rank int, vec_id long, score long"
    for w in range(waves):
        own = asked.where(F.pmod(F.xxhash64("id", "row"), F.lit(waves)) == w).select("row", "id", "v").collect()
        _search(distinct, cells, own, marks, some, k, reads, f"{out}/wave={w}")
    forget(rows, cells, distinct)
    return spark.read.schema(result).parquet(*[f"{out}/wave={w}" for w in range(waves)])


def _search(distinct: DataFrame, cells: DataFrame, own: list, marks: dict[int, Marks], some: list[np.ndarray], k: int, reads: list[tuple[int, int]] | None, path: str) -> None:
    """Write the best of one wave of queries (row, id, v)."""
    spark = distinct.sparkSession
    queries: dict[int, Wave] = {}
    for d in sorted({len(r.v) // 8 for r in own}):
        mine = [r for r in own if len(r.v) == 8 * d]
        q = np.frombuffer(b"".join(r.v for r in mine), "<f8").reshape(len(mine), d)
        seeds = [s for s in some if len(s) == d]
        beat = np.full(len(mine), -np.inf)
        if len(seeds) > k:
            with np.errstate(over="ignore", invalid="ignore"):
                got = q @ np.array(seeds).reshape(len(seeds), d).T
                # one of them may be the query's own; products of doubles are rounded
                beat = np.partition(got, -k - 1, axis=1)[:, -k - 1]
                beat = np.nan_to_num(beat - np.abs(beat) * 1e-9 - np.abs(got).max(axis=1) * 1e-9 - 1, nan=-np.inf)
        queries[d] = Wave(np.array([r.row for r in mine], np.int64), q, beat, marks[d])
    sent = spark.sparkContext.broadcast(queries)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = {d: Scanner(wave, k) for d, wave in sent.value.items()}
        for batch in batches:
            for d, entries, c in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if d in scanners:
                    e = np.frombuffer(entries, "<i8")
                    scanners[d].add(e, np.frombuffer(c, np.uint8).reshape(len(e), d))
        for d, scanner in scanners.items():
            q, *found = scanner.found()
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), d, np.int32)), pa.array(q), *map(pa.array, found)], ["d", "q", "entry", "low", "high"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, q = batch.column("d").to_numpy(), batch.column("q").to_numpy()
            score = np.zeros(len(batch), np.int64)
            for length, (rows, v) in _matrix(batch.column("v")).items():
                score[rows] = scores(sent.value[length].vectors[q[rows]], v)
            asked = np.array([sent.value[a].number[b] for a, b in zip(d.tolist(), q.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("q"), pa.array(asked), batch.column("members"), pa.array(score)], ["d", "q", "asked", "members", "score"])

    member = "members array<struct<id:bigint,row:bigint>>"
    by = Window.partitionBy("d", "q")
    # each task's candidates, and the place of each by its upper bound; what is below the k-th lower bound of all is out
    bounds = cells.mapInArrow(bound, "d int, q long, entry long, low double, high double")
    placed = bounds.withColumn("kth", F.row_number().over(by.orderBy(F.desc("low")))).withColumn("beat", F.max(F.when(F.col("kth") == k + 1, F.col("low"))).over(by))
    left = stored(placed.where(F.coalesce(F.col("high") >= F.col("beat"), F.lit(True))).withColumn("place", F.row_number().over(by.orderBy(F.desc("high"), "entry"))).select("d", "q", "entry", "high", "place"), "bounds")

    def read(some: DataFrame) -> DataFrame:
        joined = some.join(distinct, "entry").select("d", "q", "v", "members")
        return stored(joined.mapInArrow(exact, f"d int, q long, asked long, {member}, score long").select("d", "q", "asked", "score", F.explode("members").alias("m")).where("m.row <> asked"), "exact")

    first = read(left.where(F.col("place") <= 2 * k))
    best = by.orderBy(F.desc("score"), "m.id", "m.row")
    certain = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("d", "q", F.col("score").alias("sure"))
    rest = left.where(F.col("place") > 2 * k).join(certain, ["d", "q"], "left").where(F.col("sure").isNull() | (F.col("high") >= F.col("sure")))
    more = read(rest.select("d", "q", "entry"))
    if reads is not None:
        entries = {r.d: r.n for r in distinct.groupBy((F.octet_length("v") / 8).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        pairs = sum(len(wave.number) * entries[d] for d, wave in queries.items())
        reads.append((pairs, left.where(F.col("place") <= 2 * k).count() + rest.count()))
    ids = spark.createDataFrame([(r.row, r.id) for r in own], "asked long, query_id long")
    ranked = first.union(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked.join(ids, "asked").select("query_id", "rank", F.col("m.id").alias("vec_id"), "score").write.parquet(path)
    forget(left, first, more)
    sent.unpersist()
