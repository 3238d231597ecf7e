"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint is cut into partitions of 16 bits. Two fingerprints at distance
``tau`` or less are within ``t_i`` in some partition i, if the thresholds
``t_i >= -1`` of all partitions add up to ``tau - partitions + 1``. So each
fingerprint probes, in each partition, the values within its threshold there,
and every hit is verified at full length.

* Bits that are set together go to the same partition: it then has few frequent
  values and many rare ones, and thresholds can differ with profit.
* The thresholds are allocated for each fingerprint by dynamic programming, so
  that the estimated number of candidates is least. The estimates are exact
  counts: a table of how many fingerprints have each of the 65,536 values of a
  partition, summed over Hamming balls.

Equal fingerprints are one node. A frequent value's fingerprints are dealt to
several blocks of bounded size, and all its probes visit each block. Blocks put
out a spanning forest of the links they find, not the pairs themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import prefixes, shingles
from tessella.llm.common import forget, map_texts, marked, passed, release, ship, sized, stored
from tessella.llm.components import components, roots

PART = 16
VALUES = 1 << PART
#: Fingerprints of one value that a block holds at most, about.
BLOCK_ROWS = 20_000
#: Pairs that are compared in one NumPy step.
PAIRS = 1 << 20
#: Partitions that are searched ahead; what they link needs no links from the others.
FIRST_PARTS = 4
#: Multipliers that derive further fingerprint words from one shingle hash: odd numbers from the golden ratio.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprints(hashes: np.ndarray, words: int) -> list[int]:
    """``words`` SimHash words; the first is over the hashes themselves, the others over remixed ones."""
    out = [shingles.fingerprint(hashes)]
    for k in range(1, words):
        with np.errstate(over="ignore"):
            h = (hashes ^ (np.uint64(k) * _MIX)) * _MIX
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        out.append(shingles.fingerprint(h))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_texts(docs: DataFrame, *, shingle: int, words: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``f0``.. (fingerprint words) and ``n`` (shingles) of every whole text.

    With ``distinct`` a repeated shingle counts once, and ``digest`` tells the
    sets of shingles apart by 128 bits.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = shingles.many_shingle_hashes(batch.column(1).to_pylist(), shingle)
            digests = []
            if distinct:
                hashed = [np.unique(h) for h in hashed]
                digests = [pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in hashed], pa.binary())]
            prints = [fingerprints(h, words) for h in hashed]
            columns = [pa.array([_signed(p[k]) for p in prints], pa.int64()) for k in range(words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([len(h) for h in hashed], pa.int64()), *digests], ["id", *[f"f{k}" for k in range(words)], "n", *["digest"] * distinct])

    schema = "id long, " + ", ".join(f"f{k} long" for k in range(words)) + ", n long" + ", digest binary" * distinct
    return map_texts(docs, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], work, schema)


def _matrix(batch: pa.RecordBatch, words: int) -> np.ndarray:
    """Fingerprints as rows of unsigned words."""
    return np.stack([batch.column(f"f{k}").to_numpy(zero_copy_only=False).view(np.uint64) for k in range(words)], axis=1)


def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")


def _collected(sums: DataFrame, size: int, chunk: int) -> np.ndarray:
    """Sums ``x`` at places ``at`` below ``size`` as one array: packed by executors, so that the driver holds no row for each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(at // chunk).tolist():
                own = at // chunk == p
                held.setdefault(p, np.zeros(chunk, np.int64))[at[own] - p * chunk] = x[own]
        for p, array in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([array.tobytes()], pa.binary())], ["p", "x"])

    out = np.zeros(-(-size // chunk) * chunk, np.int64)
    dealt = sums.repartition(F.floor(F.col("at") / chunk)).select("at", "x")
    for r in dealt.mapInArrow(pack, "p long, x binary").toLocalIterator():
        out[r.p * chunk : (r.p + 1) * chunk] = np.frombuffer(r.x, np.int64)
    return out[:size]


def bit_order(nodes: DataFrame, words: int) -> list[int]:
    """All bits, those that are set together next to each other.

    One pass sums co-occurrences in each task; the driver gets words**2 * 4096
    sums. Partitions are grown greedily: the first free bit, then always the
    free bit most correlated with those already in.
    """
    size = 64 * words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, size)), 0
        for batch in batches:
            b = _bits(_matrix(batch, words)).astype(np.float32)
            for s in range(0, len(b), 4096):
                part = b[s : s + 4096]
                total += part.T @ part
            n += len(b)
        if n:
            flat = total.ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size + 1, dtype=np.int64)), pa.array(np.append(flat, n))], ["at", "x"])

    summed = nodes.select(*[f"f{k}" for k in range(words)]).mapInArrow(work, "at long, x long").groupBy("at").agg(F.sum("x").alias("x"))
    sums = _collected(summed, size * size + 1, size * size + 1)
    n = max(sums[-1], 1.0)
    both = sums[:-1].reshape(size, size) / n
    mean = np.diag(both)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs((both - np.outer(mean, mean)) / np.outer(sd, sd))
    free, order = list(range(size)), []
    while free:
        group = [free.pop(0)]
        while len(group) < PART and free:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        order += group
    return order


def part_values(prints: np.ndarray, order: list[int]) -> np.ndarray:
    """The 16-bit value of each partition, one row for each fingerprint."""
    bits = _bits(prints)[:, order]
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u2").reshape(len(prints), -1)


def _ball_offsets(radius: int) -> list[np.ndarray]:
    """XOR masks at distance 0, 1, .. ``radius``."""
    masks = np.arange(VALUES, dtype=np.uint32)
    weight = np.bitwise_count(masks)
    return [masks[weight == r].astype(np.uint16) for r in range(radius + 1)]


def ball_counts(counts: np.ndarray, radius: int) -> np.ndarray:
    """How many fingerprints lie within 0..``radius`` of each value: [radius + 1, values]."""
    layers = np.zeros((radius + 1, VALUES))
    layers[0] = counts
    for bit in range(PART):
        moved = layers.reshape(radius + 1, -1, 2, 1 << bit)[:, :, ::-1].reshape(radius + 1, VALUES)
        layers[1:] += moved[:-1].copy()
    return np.cumsum(layers, axis=0)


def allocate(estimates: np.ndarray, budget: int) -> np.ndarray:
    """Thresholds of least cost for each row of ``estimates`` [rows, partitions, steps].

    Step s of a partition is threshold s - 1 (step 0: don't look there). The
    steps of a row add up to ``budget``, which is tau + 1.
    """
    rows, parts, steps = estimates.shape
    cost = np.full((rows, budget + 1), np.inf)
    cost[:, 0] = 0
    chosen = np.zeros((parts, rows, budget + 1), np.int8)
    for p in range(parts):
        new = np.full_like(cost, np.inf)
        for s in range(min(steps, budget + 1)):
            candidate = cost[:, : budget + 1 - s] + estimates[:, p, s : s + 1]
            better = candidate < new[:, s:]
            new[:, s:][better] = candidate[better]
            chosen[p][:, s:][better] = s
        cost = new
    out = np.zeros((rows, parts), np.int64)
    left = np.full(rows, budget)
    for p in range(parts - 1, -1, -1):
        out[:, p] = chosen[p][np.arange(rows), left]
        left -= out[:, p]
    return out - 1


@dataclass(frozen=True)
class Plan:
    """What probing needs beside the fingerprints; of a size fixed by the number of partitions."""

    order: list[int]
    counts: np.ndarray
    tau: int
    block_rows: int

    @property
    def parts(self) -> int:
        return len(self.order) // PART


def make_plan(nodes: DataFrame, words: int, tau: int, block_rows: int = BLOCK_ROWS) -> Plan:
    order = bit_order(nodes, words)
    parts = 4 * words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(parts * VALUES, np.int64)
        for batch in batches:
            values = part_values(_matrix(batch, words), order).astype(np.int64)
            np.add.at(counts, (values + np.arange(parts) * VALUES).ravel(), 1)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "x"])

    counted = nodes.select(*[f"f{k}" for k in range(words)]).mapInArrow(work, "at long, x long").groupBy("at").agg(F.sum("x").alias("x"))
    counts = _collected(counted, parts * VALUES, VALUES)
    return Plan(order, counts.reshape(parts, VALUES), tau, block_rows)


class Radii:
    """The thresholds of fingerprints in each partition under a plan."""

    def __init__(self, plan: Plan):
        self.plan, self.budget = plan, plan.tau + 1
        self.steps = min(self.budget + 1, 3 + self.budget // plan.parts)
        sizes = np.cumsum([len(b) for b in _ball_offsets(self.steps - 2)])
        # a probe costs as much as some candidates: it is a row that moves
        self.cost = np.stack([ball_counts(c, self.steps - 2) for c in plan.counts]) + 2.0 * sizes[None, :, None]

    def of(self, values: np.ndarray) -> np.ndarray:
        """Thresholds for rows of partition values: [rows, partitions]."""
        zero = np.zeros((len(values), self.plan.parts, 1))
        at = np.stack([self.cost[p][:, values[:, p]].T for p in range(self.plan.parts)], axis=1)
        return allocate(np.concatenate([zero, at], axis=2), self.budget)


_ROLE_ROWS = "key long, block int, probe boolean, node long, label long"


def _rank(prints: np.ndarray) -> np.ndarray:
    """An order of fingerprints that doesn't depend on how nodes are numbered."""
    h = np.zeros(len(prints), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(prints.shape[1]):
            h = (h ^ prints[:, k]) * _MIX
            h ^= h >> np.uint64(29)
    return h


def _expand(plan_of, words: int, stop: int):
    """Fingerprints to rows of the index and probes, both in the first ``stop`` partitions."""
    names = [f"f{k}" for k in range(words)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = plan_of.value
        radii = Radii(plan)
        balls = _ball_offsets(radii.steps - 2)
        blocks_of = -(-plan.counts // plan.block_rows)
        for batch in batches:
            prints, node = _matrix(batch, words), batch.column("node").to_numpy(zero_copy_only=False)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for s in range(0, len(prints), 4096):
                part, own, group = prints[s : s + 4096], node[s : s + 4096], label[s : s + 4096]
                values = part_values(part, plan.order).astype(np.int64)
                rows = np.arange(len(part))
                keys, block, probe, at = [], [], [], []
                with np.errstate(over="ignore"):
                    spread = (own.view(np.uint64) * _MIX) >> np.uint64(33)
                for p in range(stop):
                    n_blocks = np.maximum(blocks_of[p][values[:, p]], 1)
                    keys.append(values[:, p] + p * VALUES)
                    block.append((spread % n_blocks.astype(np.uint64)).astype(np.int64))
                    probe.append(np.zeros(len(part), bool))
                    at.append(rows)
                radius = radii.of(values)
                for p in range(stop):
                    for r in range(radii.steps - 1):
                        who = np.flatnonzero(radius[:, p] >= r)
                        if not len(who):
                            break
                        hit = values[who, p][:, None] ^ balls[r][None, :].astype(np.int64)
                        who = np.repeat(who, len(balls[r]))
                        hit = hit.ravel()
                        some = plan.counts[p][hit] > 0
                        who, hit = who[some], hit[some]
                        n = blocks_of[p][hit]
                        who, hit = np.repeat(who, n), np.repeat(hit, n)
                        first = np.repeat(np.cumsum(n) - n, n)
                        keys.append(hit + p * VALUES)
                        block.append(np.arange(len(hit)) - first)
                        probe.append(np.ones(len(hit), bool))
                        at.append(who)
                where, keys, block, probe = (np.concatenate(c) for c in (at, keys, block, probe))
                for lo in range(0, len(where), 200_000):
                    cut = slice(lo, lo + 200_000)
                    w = where[cut]
                    columns = [keys[cut], block[cut].astype(np.int32), probe[cut], own[w], group[w], *[part[w, k].view(np.int64) for k in range(words)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "block", "probe", "node", "label", *names])

    return work


def _linker(plan_of, words: int, sure: int, unsure: int, nearest: bool):
    """Compare probes with the index rows of their key and block; rows come sorted, index rows first.

    An unsure pair is put out by the first partition where its fingerprints
    meet, so once. With ``nearest`` a probe puts out the closest of its unsure
    pairs only.
    """
    held_radii: list[Radii] = []

    def first_meeting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The first partition where probes ``x`` look for ``y``."""
        plan: Plan = plan_of.value
        if not held_radii:
            held_radii.append(Radii(plan))
        out = []
        for lo in range(0, len(x), 4096):
            v, w = (part_values(z[lo : lo + 4096], plan.order) for z in (x, y))
            out.append((np.bitwise_count(v ^ w) <= held_radii[0].of(v.astype(np.int64))).argmax(axis=1))
        return np.concatenate(out)

    def links(data: np.ndarray, ids: np.ndarray, probes: np.ndarray, probers: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        """Probes and index rows within ``unsure`` of each other, and their distances; a pair counts from one side only."""
        at = 0
        ends = np.cumsum(counts)
        ahead_of, behind = _rank(probes), _rank(data)
        while at < len(probes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
            n = counts[at:to]
            q = np.repeat(np.arange(at, to), n)
            d = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[at:to], n)
            apart = probers[q, 1] != ids[d, 1]
            q, d = q[apart], d[apart]
            x, y = ahead_of[q], behind[d]
            ahead = (x < y) | ((x == y) & (probers[q, 0] < ids[d, 0]))
            q, d = q[ahead], d[ahead]
            distance = np.zeros(len(q), np.int64)
            for k in range(words):
                distance += np.bitwise_count(probes[q, k] ^ data[d, k])
            near = np.flatnonzero(distance <= unsure)
            yield q[near], d[near], distance[near]
            at = to

    def root_of(v: np.ndarray, known: np.ndarray, root: np.ndarray) -> np.ndarray:
        if not len(known):
            return v
        at = np.minimum(np.searchsorted(known, v), len(known) - 1)
        return np.where(known[at] == v, root[at], v)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, held_ids = -1, np.zeros((0, words), np.uint64), np.zeros((0, 2), np.int64)
        for batch in sized(batches, prefixes.BATCH_ROWS):
            key = batch.column("key").to_numpy(zero_copy_only=False) << 24 | batch.column("block").to_numpy(zero_copy_only=False).astype(np.int64)
            probe = batch.column("probe").to_numpy(zero_copy_only=False).astype(bool)
            id_, prints = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label")], axis=1), _matrix(batch, words)
            # what the last batch left of this batch's first key comes before it
            data = np.concatenate([held, prints[~probe]])
            ids = np.concatenate([held_ids, id_[~probe]])
            data_keys = np.concatenate([np.full(len(held), held_key), key[~probe]])
            probes, probers, probe_keys = prints[probe], id_[probe], key[probe]
            starts = np.searchsorted(data_keys, probe_keys, side="left")
            counts = np.searchsorted(data_keys, probe_keys, side="right") - starts
            a, b, c = [], [], []
            for q, d, distance in links(data, ids, probes, probers, starts, counts):
                if not len(q):
                    continue
                # sure links become stars; an unsure one is needed only between two of them
                near = distance <= sure
                known, root = roots(probers[q[near], 1], ids[d[near], 1])
                away = known != root
                a += [known[away]]
                b += [root[away]]
                c += [np.ones(away.sum(), bool)]
                q, d, distance = q[~near], d[~near], distance[~near]
                apart = root_of(probers[q, 1], known, root) != root_of(ids[d, 1], known, root)
                q, d, distance = q[apart], d[apart], distance[apart]
                if nearest:
                    order = np.lexsort((distance, q))
                    order = order[np.unique(q[order], return_index=True)[1]]
                    q, d = q[order], d[order]
                elif len(q):
                    own = first_meeting(probes[q], data[d]) == (probe_keys[q] >> 24) // VALUES
                    q, d = q[own], d[own]
                a += [probers[q, 0]]
                b += [ids[d, 0]]
                c += [np.zeros(len(q), bool)]
            if len(data_keys):
                held_key = data_keys[-1]
                last = data_keys == held_key
                held, held_ids = data[last], ids[last]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(c))], ["a", "b", "sure"])

    return work


def link(nodes: DataFrame, words: int, tau: int, *, sure: int | None = None, unsure: int | None = None, verify: Callable[[DataFrame], DataFrame] | None = None, block_rows: int = BLOCK_ROWS, ahead: bool = False) -> DataFrame:
    """Links ``a``, ``b`` that connect all nodes (``node``, ``f0``..) within ``tau`` bits.

    Pairs within ``sure`` bits (tau, if not given; -1 for none) are links. Pairs beyond, up
    to ``unsure`` bits, are links if ``verify`` keeps them. Pairs beyond
    ``tau`` are found where they meet, which depends on the fingerprints alone
    and not on how nodes are numbered.

    Links come as spanning forests. With many partitions a group would be linked
    anew in each of them, and unsure pairs would grow with the square of its
    size. So a few partitions are searched ahead, with one unsure pair for a
    probe. What is linked there is contracted, and then all partitions are
    searched for every pair of nodes that are not yet together. With ``ahead``
    the second search is left to the caller.
    """
    spark = nodes.sparkSession
    ship(spark)
    plan = make_plan(nodes, words, tau, block_rows)
    parts, shared = plan.parts, spark.sparkContext.broadcast(plan)
    names = [f"f{k}" for k in range(words)]
    sure = tau if sure is None else sure

    def search(labelled: DataFrame, stop: int, nearest: bool) -> DataFrame:
        rows = labelled.select("node", "label", *names).mapInArrow(_expand(shared, words, stop), _ROLE_ROWS + "".join(f", {f} long" for f in names))
        dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "probe")
        found = dealt.mapInArrow(_linker(shared, words, sure, max(sure, unsure or sure), nearest), "a long, b long, sure boolean")
        pairs = stored(found.distinct(), "links")
        certain = pairs.where("sure").select("a", "b")
        return certain if verify is None else certain.union(verify(pairs.where("not sure").select("a", "b")))

    alone = nodes.withColumn("label", F.col("node"))
    if ahead:
        return search(alone, min(parts, FIRST_PARTS), True)
    if parts <= FIRST_PARTS:
        return search(alone, parts, False)
    known = components(search(alone, FIRST_PARTS, True))
    labelled = stored(nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("label"), *names), "nodes")
    stars = labelled.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    return stars.union(search(labelled, parts, False))


def near_duplicates(docs: DataFrame, *, shingle: int = 4, tau: int = 4, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose 64-bit fingerprints are linked, over any number of links.

    Returns one row for each input row: the id, ``fingerprint`` (16 hex
    digits) and ``component_id``, the smallest id reachable, its own included.
    A null or empty text has fingerprint zero and is linked like any other. A
    null id reaches nothing smaller than the other ids of its component; it is
    null itself where there are none. Other columns are not read.
    """
    prints = stored(fingerprint_texts(docs, shingle=shingle, id_col=id_col, text_col=text_col), "prints")
    nodes = stored(prints.groupBy(F.col("f0").alias("node")).agg(F.min("id").alias("least")).withColumn("f0", F.col("node")), "nodes")
    linked = components(link(nodes, 1, tau, block_rows=block_rows))
    labelled = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = labelled.join(least, "component").select(F.col("node").alias("f0"), "component_id")
    out = prints.join(of_node, "f0")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def _jaccard(shingle: int, least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.unique(h) for h in shingles.many_shingle_hashes(batch.column("x").to_pylist(), shingle)]
            y = [np.unique(h) for h in shingles.many_shingle_hashes(batch.column("y").to_pylist(), shingle)]
            shared = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)]
            ok = [s >= least * (len(p) + len(q) - s) for s, p, q in zip(shared, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return work


#: Words of the fingerprints that ``drop_near_copies`` compares; 512 bits tell similarities of 0.8 and 0.7 apart by four deviations.
WIDE = 8


def drop_near_copies(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, words: int = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies: of each group of documents linked by a Jaccard
    similarity of ``similarity`` or more over word shingles, the one with the smallest id stays.

    Equal sets of shingles are one node. Wide fingerprints of the sets find the
    first candidates: the share of bits in which two differ estimates their
    similarity s as acos(2 s / (1 + s)) / pi, and pairs beyond ``similarity`` by
    three deviations are left out. What is linked so is contracted. All other
    pairs that can be similar are found by prefix filtering (``prefixes``),
    which misses none: in rounds of nearest candidates, so that a large group
    becomes one node before all pairs are looked at. Every candidate is checked exactly on whole texts before
    it is a link. Texts without words are no copies of one another and all stay,
    as do null ids with unequal texts.
    """
    spark = docs.sparkSession
    n_bits = 64 * words
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    spread = float(np.sqrt(share * (1 - share) * n_bits))
    unsure = int(n_bits * share + 3 * spread)
    whole = stored(docs.select(F.struct(*docs.columns).alias("__row"), F.monotonically_increasing_id().alias("__id")), "rows")
    keyed = whole.select("__id", F.col(f"__row.{id_col}").cast("long").alias("__doc"), F.col(f"__row.{text_col}").alias("__text"))
    prints = fingerprint_texts(keyed, shingle=shingle, words=words, distinct=True, id_col="__id", text_col="__text")
    names = [f"f{k}" for k in range(words)]
    prints = stored(prints.join(keyed.select(F.col("__id").alias("id"), "__doc"), "id"), "prints")
    sets = prefixes.prefixes(keyed, shingle, similarity, id_col="__id", text_col="__text")
    # equal sets of shingles: one node, named by its first row
    empty = prints.where("n = 0").select(F.col("id").alias("__id"))
    full = prints.where("n > 0")
    nodes = stored(full.groupBy("digest", *names).agg(F.min(F.struct(F.col("__doc").isNull().alias("none"), "__doc", "id")).alias("first")).select(F.col("first.id").alias("node"), F.col("first.__doc").alias("doc"), *names), "nodes")
    # texts of nodes that share a shingle of their prefixes with another; no other can be similar to one
    rows = prefixes.shared_rows(sets.join(nodes.select("node"), "node", "left_semi"))
    place = F.pmod(F.xxhash64("node"), F.lit(prefixes.FILTER_BITS))
    bits = spark.sparkContext.broadcast(marked(rows.select(place.alias("place")), prefixes.FILTER_BITS))
    met = passed(keyed.select(F.col("__id").alias("node"), F.col("__text").alias("x")), place, bits)
    text = stored(met.join(rows.select("node").distinct().hint("shuffle_hash"), "node", "left_semi"), "texts")
    info = stored(sets.drop("prefix"), "info")
    forget(sets)
    release(spark)

    def similar(pairs: DataFrame) -> DataFrame:
        both = pairs.join(text.withColumnRenamed("node", "a"), "a").join(text.select(F.col("node").alias("b"), F.col("x").alias("y")), "b")
        return map_texts(both, ["a", "b", "x", "y"], _jaccard(shingle, similarity), "a long, b long, ok boolean").where("ok").select("a", "b")

    def labels(known: DataFrame) -> DataFrame:
        return stored(nodes.select("node").join(known, "node", "left").select("node", F.coalesce("component", "node").alias("label")), "labels")

    together = labels(components(link(nodes, words, 4 * words - 1, sure=-1, unsure=unsure, verify=similar, ahead=True)))
    settled = False
    for nearest in [*[True] * prefixes.ROUNDS, False]:
        if settled and nearest:
            continue
        pairs = prefixes.candidates(rows, info, together, similarity, nearest=nearest)
        found = stored(similar(pairs), "links")
        settled = found.isEmpty()
        stars = together.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        now = labels(components(stars.union(found)))
        forget(pairs, found, together)
        together = now
        release(spark)
    labelled = nodes.select("node", "doc").join(together, "node")
    first = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "node")).alias("first"))
    stay = stored(first.select(F.col("first.node").alias("__id")).union(empty), "stay")
    forget(prints, info, nodes, rows, text, together)
    return whole.join(stay.hint("shuffle_hash"), "__id", "left_semi").select("__row.*")
