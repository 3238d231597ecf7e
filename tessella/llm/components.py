"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import forget, ship, stored

#: Edges that one task replaces by stars.
FOREST_EDGES = 500_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some links, and the smallest node that each is linked to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: they connect the same nodes with one edge less than there are nodes."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        nodes, root = roots(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))
        away = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(root[away])], ["u", "v"])




def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """Columns ``node`` and ``component`` (smallest node reachable) for every node of ``edges`` (``a``, ``b``).

    Each round connects larger neighbours to the smallest one (large star) and
    then smaller ones (small star); rounds grow with the logarithm of the
    largest component. Every round's edges are written to the shared folder, so
    lost executors cost one round. No table is gathered on the driver; a node
    with many edges is a join key with one row on the other side, which skew
    handling can split. Self-loops and repeated edges do no harm. Raises
    RuntimeError if ``most_rounds`` are not enough.
    """
    given = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    # many links inside one group shrink to a few for each node before any join
    ship(edges.sparkSession)
    now = stored(given.coalesce(max(1, -(-given.count() // FOREST_EDGES))).mapInArrow(_forest, "u long, v long"), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: v's larger neighbours hang on the smallest neighbour
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours hang on the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, now = now, stored(after, "edges")
        forget(last, given)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
