"""Candidates for a Jaccard similarity by prefix filtering; no similar pair is missed.

All shingles have one order, rare ones first. Two sets of a similarity of at
least s share one of the first ``n - ceil(s n) + 1`` shingles of each. So sets
meet at the shingles of their prefixes, and pairs are left out only by bounds
that hold for certain: sizes, places of the shared shingle, and the Hamming
distance of parity bitmaps, which is at most the size of the symmetric difference.

How rare a shingle is comes from a table of counts by hash. The table decides
how many candidates there are, never which pairs are found.

Most shingles of a prefix are in no other prefix. Those that are shared are
counted exactly; only their rows get the bitmaps and meet in blocks. A large
group of near copies would give a pair for each two members. So it is first
contracted: in a few rounds each row puts out its nearest candidate alone, and
what is linked so is one for all pairs that follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import shingles
from tessella.llm.common import forget, is_marked, map_texts, marked, ship, sized, stored

#: Counts of shingles are kept by so many bits of their hashes.
CELL_BITS = 20
#: Words of a parity bitmap.
BITMAP = 8
#: Rows of one shingle that a block holds at most, about.
BLOCK_ROWS = 20_000
#: Pairs that are compared in one NumPy step.
PAIRS = 1 << 20
#: Rows that are worked on together.
BATCH_ROWS = 50_000
#: Bits of the filter of shared shingles: 16 MB.
FILTER_BITS = 1 << 27
#: Shingles with more rows than this are contracted in rounds before all their pairs are looked at.
FEW = 8
#: Rounds in which nearest candidates are linked, at most.
ROUNDS = 4
_SHIFT = np.uint64(64 - CELL_BITS)
#: Keeps products of sizes and similarities from being rounded up past a whole number.
_SLACK = 1e-6
BOTH, INDEX, PROBE = 0, 1, 2


def shingle_counts(docs: DataFrame, shingle: int, *, text_col: str = "text") -> np.ndarray:
    """About how many texts have the shingles of each cell, one cell for each value of the hashes' first bits."""
    cells, chunk = 1 << CELL_BITS, 1 << CELL_BITS - 6

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for h in shingles.many_shingle_hashes(batch.column(0).to_pylist(), shingle):
                np.add.at(total, (np.unique(h) >> _SHIFT).astype(np.int64), 1)
        packed = np.minimum(total, 65535).astype("<u2").reshape(-1, chunk)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(packed))), pa.array([p.tobytes() for p in packed], pa.binary())], ["p", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(p, np.zeros(chunk, np.int64))[:] += np.frombuffer(x.as_py(), "<u2")
        for p, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["p", "x"])

    out = np.zeros(cells, np.int64)
    counted = map_texts(docs, [F.col(text_col).alias("text")], count, "p long, x binary")
    for r in counted.repartition("p").mapInArrow(add, "p long, x binary").toLocalIterator():
        out[r.p * chunk : (r.p + 1) * chunk] = np.frombuffer(r.x, np.int64)
    return out


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bit i is 1 if an odd number of the hashes belong to it."""
    size = 64 * BITMAP
    odd = np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def prefix(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set (distinct ``hashes``) in the common order."""
    n = len(hashes)
    order = np.lexsort((hashes, counts[(hashes >> _SHIFT).astype(np.int64)]))
    return hashes[order[: n - int(np.ceil(similarity * n - _SLACK)) + 1]]


def prefixes(docs: DataFrame, shingle: int, similarity: float, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``node`` (the id), ``size`` (distinct shingles), ``prefix`` and the bitmap ``b0``.. of every text with words."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(shingle_counts(docs, shingle, text_col=text_col))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            hashed = [np.unique(h) for h in shingles.many_shingle_hashes(batch.column(1).to_pylist(), shingle)]
            some = [i for i, h in enumerate(hashed) if len(h)]
            maps = np.array([bitmap(hashed[i]) for i in some], np.uint64).reshape(-1, BITMAP)
            columns = [batch.column(0).take(pa.array(some, pa.int64())), pa.array([len(hashed[i]) for i in some], pa.int64())]
            columns.append(pa.array([prefix(hashed[i], counts, similarity).tobytes() for i in some], pa.binary()))
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(maps[:, k].copy().view(np.int64)) for k in range(BITMAP)]], ["node", "size", "prefix", *[f"b{k}" for k in range(BITMAP)]])

    schema = "node long, size long, prefix binary" + "".join(f", b{k} long" for k in range(BITMAP))
    return stored(map_texts(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text")], work, schema), "prefixes")


def _exploded(sets: DataFrame, bits=None) -> DataFrame:
    """A row for each shingle of a prefix: ``key``, ``place`` and ``node``; with a filter, of the marked ones alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 500):
                batch = whole.slice(lo, 500)
                own = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("prefix")]
                lengths = np.array([len(x) for x in own])
                place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                key, node = np.concatenate(own), np.repeat(batch.column("node").to_numpy(), lengths)
                if bits is not None:
                    keep = is_marked(bits.value, key & (FILTER_BITS - 1))
                    key, place, node = key[keep], place[keep], node[keep]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place.astype(np.int32)), pa.array(node)], ["key", "place", "node"])

    ship(sets.sparkSession)
    return sets.select("node", "prefix").mapInArrow(work, "key long, place int, node long")


def shared_rows(sets: DataFrame) -> DataFrame:
    """The rows of shingles that two or more prefixes have: ``key``, ``place``, ``node`` and ``n`` (prefixes that have it), stored.

    A filter of fixed size takes out most others before the join that decides.
    """
    counts = stored(_exploded(sets).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    bits = sets.sparkSession.sparkContext.broadcast(marked(counts.select(F.col("key").bitwiseAND(FILTER_BITS - 1).alias("place")), FILTER_BITS))
    out = stored(_exploded(sets, bits).join(counts, "key"), "shared")
    forget(counts)
    return out


def _dealt(rows: DataFrame, nearest: bool, block_rows: int) -> DataFrame:
    """Rows with their blocks: one with many rows of a key has several. All of them get a probe, unless just the nearest is wanted."""
    blocks = F.ceil(F.col("n") / block_rows)
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    if nearest:
        return rows.withColumn("block", own).withColumn("role", F.lit(BOTH).cast("byte")).drop("n")
    one = F.array(F.struct(F.lit(0).alias("block"), F.lit(BOTH).cast("byte").alias("role")))
    probes = F.transform(F.sequence(F.lit(0), (blocks - 1).cast("int")), lambda b: F.struct(b.alias("block"), F.lit(PROBE).cast("byte").alias("role")))
    several = F.concat(F.array(F.struct(own.alias("block"), F.lit(INDEX).cast("byte").alias("role"))), probes)
    return rows.withColumn("to", F.explode(F.when(blocks > 1, several).otherwise(one))).select("*", "to.*").drop("to", "n")


def _pairs(similarity: float, nearest: bool):
    """Pairs of rows of one key and block that may be similar; rows come sorted, probes last.

    With ``nearest`` a row puts out the nearest of those before it alone.
    """
    words = [f"b{k}" for k in range(BITMAP)]
    numbers = ["key", "block", "role", "place", "node", "label", "size"]

    def close(y: np.ndarray, yb: np.ndarray, q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = (y[q, 5] != y[d, 5]) & ((y[q, 2] == BOTH) | (y[q, 4] < y[d, 4]))
        q, d = q[apart], d[apart]
        n, m = y[q, 6], y[d, 6]
        shared = np.ceil(similarity / (1 + similarity) * (n + m) - _SLACK)
        # similar sets pass at the first shingle that they share
        ok = (np.minimum(n - y[q, 3], m - y[d, 3]) >= shared) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - _SLACK)
        q, d, most = q[ok], d[ok], (n + m - 2 * shared)[ok]
        differ = np.zeros(len(q), np.int64)
        for k in range(BITMAP):
            differ += np.bitwise_count(yb[q, k] ^ yb[d, k])
        ok = differ <= most
        if not nearest:
            return q[ok], d[ok]
        q, d = q[ok], d[ok]
        order = np.lexsort((differ[ok], q))
        order = order[np.unique(q[order], return_index=True)[1]]
        return q[order], d[order]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bits = np.zeros((0, len(numbers)), np.int64), np.zeros((0, BITMAP), np.uint64)
        for batch in sized(batches, BATCH_ROWS):
            x = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in numbers], axis=1)
            xb = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in words], axis=1)
            # what the last batches left of this batch's first key and block comes before it
            same = (held[:, :2] == x[0, :2]).all(axis=1)
            y, yb = np.concatenate([held[same], x]), np.concatenate([held_bits[same], xb])
            new = np.flatnonzero((y[1:, :2] != y[:-1, :2]).any(axis=1)) + 1
            first = np.zeros(len(y), np.int64)
            first[new] = new
            first = np.maximum.accumulate(first)
            old = same.sum()
            at = np.arange(old, len(y))
            at = at[y[at, 2] != INDEX]
            counts = at - first[at]
            ends = np.cumsum(counts)
            lo, a, b = 0, [], []
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
                n = counts[lo:hi]
                q = np.repeat(at[lo:hi], n)
                d = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at[lo:hi]], n)
                keep = y[d, 2] != PROBE
                q, d = close(y, yb, q[keep], d[keep])
                a.append(np.minimum(y[q, 4], y[d, 4]))
                b.append(np.maximum(y[q, 4], y[d, 4]))
                lo = hi
            last = (y[:, :2] == y[-1, :2]).all(axis=1) & (y[:, 2] != PROBE)
            held, held_bits = y[last], yb[last]
            if a:
                found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    return work


def candidates(rows: DataFrame, info: DataFrame, labels: DataFrame, similarity: float, *, nearest: bool = False, block_rows: int | None = None) -> DataFrame:
    """Pairs ``a`` < ``b`` of nodes of different ``label`` that may be similar, each once.

    ``rows`` are those of ``shared_rows``, ``info`` has the sizes and bitmaps,
    ``labels`` a label for each node that takes part. Of shingles with more
    than ``FEW`` rows, those whose nodes all have one label are left out before
    pairs are looked for. With ``nearest`` just such shingles are looked at,
    and each row puts out its nearest candidate alone.
    """
    block_rows = block_rows or BLOCK_ROWS
    words = [f"b{k}" for k in range(BITMAP)]
    wanted = rows.where(F.col("n") > FEW) if nearest else rows
    wide = wanted.join(info.join(labels, "node"), "node").select("key", "n", "place", "node", "label", "size", *words)
    many = rows.where(F.col("n") > FEW).join(labels, "node")
    mixed = many.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key")
    kept = wide.where(F.col("n") > FEW).join(mixed, "key")
    if not nearest:
        kept = wide.where(F.col("n") <= FEW).unionByName(kept)
    dealt = _dealt(kept, nearest, block_rows).select("key", "block", "role", "place", "node", "label", "size", *words)
    sorted_ = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "role")
    return stored(sorted_.mapInArrow(_pairs(similarity, nearest), "a long, b long").distinct(), "pairs")
