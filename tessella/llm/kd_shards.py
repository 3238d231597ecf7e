"""Shards of near-equal bytes from a k-d tree over metadata.

The tree splits nodes in two, along the dimension in which the node's rows
spread widest, at a weighted median, until each leaf holds one shard's share of
the bytes. A node for ``k`` shards is split so that its halves hold
``floor(k/2) / k`` and the rest of its bytes, so any number of shards works.

Strings enter by their rank among the distinct values of their column. Each
split value is found by distributed passes over a narrow table: a histogram of
the bytes over equal-width cells of each node's dimension, then of the cell
that holds the median, until that cell holds one value. Rows with that value
are told apart by a hash, and rows with that hash by their number in the stored
table. All nodes of a level are searched in the same passes, so the number of
passes follows the depth of the tree, not the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import forget, listed, numbered, stored

#: Cells of a histogram pass.
CELLS = 1024
_TIES = 1 << 48
#: How a node's rows are told apart, and up to which value the next key goes: by its dimension, then by hash, then by number.
_KEYS = {"v": float(_TIES), "tie": float(1 << 62), "row": 0.0}


@dataclass
class Node:
    """A part of the space: the first of its shards, and how many it has."""

    first: int
    shards: int


@dataclass
class _Search:
    """A weighted median being searched: its range, the weight below it, the weight wanted; at last the rows of that value."""

    low: float
    high: float
    before: float
    want: float
    rows: int = 0


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with strings replaced by their rank among the column's distinct strings; null is -1.

    The driver holds one number for each part of the sorted values. Spark sends
    the ranks along where their stored size is small, else it joins by shuffle.
    """
    values, before = numbered(rows.select(F.col(column).alias("s")).where("s IS NOT NULL").distinct(), "ranks", "s")
    ranks = values.select("s", (F.col("own") + listed(before, F.col("part"), "long")).cast("double").alias("rank"))
    joined = rows.join(ranks, F.col(column) == F.col("s"), "left").drop("s")
    return joined.withColumn(column, F.coalesce("rank", F.lit(-1.0))).drop("rank")


def _by_node(numbers: dict[int, float]) -> Column:
    """A number for each node, null elsewhere."""
    first = min(numbers, default=0)
    return listed([float(numbers[k]) if k in numbers else None for k in range(first, max(numbers, default=-1) + 1)], F.col("node") - first)


def _medians(rows: DataFrame, searches: dict[int, _Search], cells: int) -> None:
    """Narrow every search to the least value up to which the wanted weight lies.

    ``rows`` has node, v and w. A pass sums the weights in equal cells of each
    range and goes on with the cell that the median is in, until that cell
    holds one value.
    """
    open_ = dict(searches)
    while open_:
        ranged = rows.select("node", "v", "w", _by_node({k: s.low for k, s in open_.items()}).alias("low"), _by_node({k: s.high for k, s in open_.items()}).alias("high"))
        ranged = ranged.where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        part = (F.col("v") - F.col("low")) / F.greatest((F.col("high") - F.col("low")) / cells, F.lit(1e-12))
        sums = F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")
        by_node: dict[int, list] = {}
        for r in sorted(ranged.groupBy("node", F.least(F.floor(part), F.lit(cells - 1)).cast("int").alias("cell")).agg(*sums).collect(), key=lambda r: r.cell):
            by_node.setdefault(r.node, []).append(r)
        for k in list(open_):
            s, own = open_[k], by_node.get(k, [])
            for i, r in enumerate(own):
                if s.before + float(r.w) >= s.want or i == len(own) - 1:
                    s.low, s.high, s.rows = r.least, r.most, r.n
                    break
                s.before += float(r.w)
            if not own or s.low == s.high:
                del open_[k]


def partition(rows: DataFrame, dims: int, shards: int, *, cells: int = CELLS) -> DataFrame:
    """Add ``shard`` to a stored table (columns ``d0``.. of double, ``w``, ``tie`` and ``row``).

    The tree grows by levels. Each row carries its node, and the table with the
    new nodes is written once for each level, so that no level computes the
    ones before it again; the table before is then removed. The driver holds a
    level's nodes, ``cells`` sums for each, and nothing of single rows.
    """
    nodes, scales, following = {0: Node(0, shards)}, None, 1
    at = rows.withColumn("node", F.lit(0))
    final: dict[int, int] = {}
    while nodes:
        final |= {k: n.first for k, n in nodes.items() if n.shards == 1}
        nodes = {k: n for k, n in nodes.items() if n.shards > 1}
        if not nodes:
            break
        ends = [f(f"d{i}").alias(f"{k}{i}") for i in range(dims) for k, f in (("lo", F.min), ("hi", F.max))]
        seen = {r.node: r for r in at.where(F.col("node") >= min(nodes)).groupBy("node").agg(F.sum("w").alias("w"), *ends).collect()}
        nodes = {k: n for k, n in nodes.items() if k in seen}  # the others hold no rows
        if not nodes:
            break
        searches, which = {}, {}
        for k, n in nodes.items():
            r = seen[k]
            spread = [r[f"hi{i}"] - r[f"lo{i}"] for i in range(dims)]
            scales = scales or [x or 1.0 for x in spread]
            d = which[k] = max(range(dims), key=lambda i: (spread[i] / scales[i], -i))
            searches[k] = _Search(r[f"lo{d}"], r[f"hi{d}"], 0.0, float(r.w) * (n.shards // 2) / n.shards)
        dim = _by_node(which)
        level = at.withColumn("v", F.coalesce(*[F.when(dim == i, F.col(f"d{i}")) for i in range(dims)]))
        left, children = {}, {}
        for k, n in nodes.items():
            half = n.shards // 2
            left[k] = following
            children |= {following: Node(n.first, half), following + 1: Node(n.first + half, n.shards - half)}
            following += 2
        # rows left of the split, and rows that agree with it in all keys so far
        below, agree, more = F.lit(False), F.lit(True), searches
        for key, next_most in _KEYS.items():
            _medians(level.where(agree).select("node", "w", F.col(key).cast("double").alias("v")), more, cells)
            own, value = F.col(key).cast("double"), _by_node({k: s.low for k, s in more.items()})
            further = {k: _Search(0.0, next_most, s.before, s.want) for k, s in more.items() if s.rows > 1 and key != "row"}
            open_ = _by_node({k: float(k in further) for k in more}) == 1
            below = below | (agree & ((own < value) | ((own == value) & ~open_)))
            agree, more = agree & (own == value) & open_, further
            if not more:
                break
        child = (_by_node(left) + F.when(below, 0).otherwise(1)).cast("int")
        now = stored(level.withColumn("node", F.coalesce(child, F.col("node"))).drop("v"), "kd")
        forget(at, rows)
        at, nodes = now, children
    return at.withColumn("shard", _by_node(final).cast("int")).drop("node")


def shard(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, str] | None = None) -> DataFrame:
    """Put every document into one of ``shards`` shards of near-equal bytes.

    Size is the text's UTF-8 bytes (null: none) plus 8. ``dims`` maps columns
    of ``docs`` to "number" or "string"; by default source, language, length
    and id, as far as there are such columns. Shards differ by about one
    document; repeated rows, which nothing tells apart but their number, are
    spread like others. Null metadata comes before all else. An empty table
    gives no rows. Returns the id, ``size``, ``text_crc32`` (null text: of
    nothing), ``law``, ``shard``, ``slot`` (gapless in each shard) and
    ``grown_shard`` (always null under this law). Other columns are not read.
    """
    if dims is None:
        usual = {"source": "string", "lang": "string", "n_chars": "number", id_col: "number"}
        dims = {c: k for c, k in usual.items() if c in docs.columns}
    values = [F.col(c).cast("string") if k == "string" else F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c, k in dims.items()]
    text = F.coalesce(F.col(text_col), F.lit(""))
    tie = F.pmod(F.xxhash64(F.col(id_col), text, *[F.col(c) for c in dims]), F.lit(_TIES))
    narrow = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("w"), F.crc32(F.encode(text, "utf-8")).cast("long").alias("crc"), tie.alias("tie"), *[v.alias(f"d{i}") for i, v in enumerate(values)],
    )
    rows = stored(narrow.withColumn("row", F.monotonically_increasing_id()), "kd")
    given = rows
    for i, k in enumerate(dims.values()):
        if k == "string":
            rows = ranked(rows, f"d{i}")
    if rows is not given:
        rows = stored(rows, "kd")
        forget(given)
    rows = partition(rows, len(values), shards)
    placed, _ = numbered(rows.select("id", "w", "crc", "shard", "tie", "row"), "slots", "shard", "tie", "row")
    # where each shard's rows start in a part, and how many it has in earlier parts: a row for each part and shard
    runs = placed.groupBy("shard", "part").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    return placed.join(runs.select("shard", "part", (before - F.col("first")).alias("shift")), ["shard", "part"]).select(
        F.col("id").alias(id_col), F.col("w").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col("own") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
