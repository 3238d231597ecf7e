"""Matching of vectors: a stated query set against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import pixel

#: Queries of a wave and rows of a block that are compared in one NumPy step.
WAVE, BLOCK = 8192, 1024
#: Cells of differences held at once.
_CELLS = 1 << 22


def _l2(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    return ((q[:, None, :] - t[None, :, :]) ** 2).sum(axis=2)


def _l1(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.abs(q[:, None, :] - t[None, :, :]).sum(axis=2)


def _angle(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2.0 - 2.0 * (q @ t.T) / np.sqrt((q * q).sum(axis=1)[:, None] * (t * t).sum(axis=1)[None, :])


def _hamming(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.bitwise_count(q[:, None, :] ^ t[None, :, :]).sum(axis=2, dtype=np.int64)


#: Distances of all queries of a block from all its rows. For ``hamming``, e is a long of bits or bytes.
METRICS = {"hamming": _hamming, "euclidean": _l2, "manhattan": _l1, "angular": _angle}


def _rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length, as a matrix."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(len(column), 8)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        raw = column.to_pylist()
        return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(train: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", *, wave: int = WAVE, own: bool = False) -> DataFrame:
    """The ``k`` nearest rows of ``train`` (vec_id, e) for each query, ties to the smaller id.

    All vectors have one length; rows with a null take no part. Rows with a
    query's own id are left out unless ``own`` is set. Queries go out in waves
    of bounded size; a task compares a wave with its rows block by block and
    puts out ``k`` rows for each query, so no pair is ever a row.
    """
    distance, spark = METRICS[metric], train.sparkSession
    asked = queries.where("vec_id IS NOT NULL AND e IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "e")
    rows = train.where("vec_id IS NOT NULL AND e IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "e")
    waves = max(1, -(-asked.count() // wave))
    whole = metric == "hamming"
    out = None
    for w in range(waves):
        mine = asked.where(F.pmod(F.xxhash64("vec_id", "e"), F.lit(waves)) == w) if waves > 1 else asked
        got = mine.toArrow()
        if not len(got):
            continue
        sent = spark.sparkContext.broadcast((got.column("vec_id").to_numpy(), _rows(got.column("e").combine_chunks())))

        def work(batches, sent=sent):
            ids, q = sent.value
            n, step = len(ids), max(1, _CELLS // max(1, BLOCK * q.shape[1]))
            best_d, best_i = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
            for batch in batches:
                for lo in range(0, len(batch), BLOCK):
                    part = batch.slice(lo, BLOCK)
                    at, t = part.column(0).to_numpy(), _rows(part.column(1))
                    for first in range(0, n, step):
                        some = slice(first, first + step)
                        d = distance(q[some], t).astype(np.float64)
                        d = d if whole else np.round(d, 9)
                        d[np.isnan(d)] = np.inf
                        if not own:
                            d[ids[some, None] == at[None, :]] = np.inf
                        every_d = np.concatenate([best_d[some], d], axis=1)
                        every_i = np.concatenate([best_i[some], np.broadcast_to(at, d.shape)], axis=1)
                        order = np.lexsort((every_i, every_d), axis=1)[:, :k]
                        best_d[some], best_i[some] = np.take_along_axis(every_d, order, 1), np.take_along_axis(every_i, order, 1)
            keep = np.isfinite(best_d)
            which = np.nonzero(keep)[0]
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(ids[which]), pa.array(best_i[keep]), pa.array(best_d[keep])], ["n", "query_id", "vec_id", "distance"])

        found = rows.mapInArrow(work, "n long, query_id long, vec_id long, distance double")
        best = Window.partitionBy("n").orderBy("distance", "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "vec_id", F.col("distance").cast("int" if whole else "double").alias("distance"), "rank")
        out = ranked if out is None else out.union(ranked)
    return out if out is not None else spark.createDataFrame([], f"query_id long, vec_id long, distance {'int' if whole else 'double'}, rank int")


def ratio_test(matches: DataFrame, ratio: float) -> DataFrame:
    """Best matches whose distance is under ``ratio`` times that of the second best."""
    two = matches.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.struct("vec_id", "distance"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second"))
    return two.where(F.col("a.distance") < ratio * F.col("second")).select("query_id", F.col("a.vec_id").alias("vec_id"), F.col("a.distance").alias("distance"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_bytes(a: Column, b: Column, size: int) -> Column:
    """Bits in which two byte strings of ``size`` differ."""
    words = range(0, size, 8)
    long = lambda c, at: F.conv(F.rpad(F.hex(F.substring(c, at + 1, 8)), 16, "0"), 16, -10).cast("long")
    total = F.lit(0)
    for at in words:
        total = total + F.bit_count(long(a, at).bitwiseXOR(long(b, at)))
    return total


def best_with_ties(df: DataFrame, n: int, by: str, value: str) -> DataFrame:
    """The ``n`` greatest of each group, and all that equal the n-th."""
    return df.withColumn("__r", F.rank().over(Window.partitionBy(by).orderBy(F.desc(value)))).where(F.col("__r") <= n).drop("__r")


def by_strength(df: DataFrame, by: str, value: str, *ties: str) -> DataFrame:
    """Rows numbered from the strongest of each group down (``place`` from 1); equals in the order of ``ties``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), *ties)))


def retain_best(df: DataFrame, n: int, by: str, value: str, *ties: str) -> DataFrame:
    """The ``n`` strongest rows of each group; ranks are cut in each task before the shuffle."""
    return by_strength(df, by, value, *ties).where(F.col("place") <= n).drop("place")


def rbf_scores(vectors: DataFrame, support: list[tuple[list[float], float]], gamma: float, bias: float) -> DataFrame:
    """Decision values of a kernel machine: sum of coefficient * exp(-gamma d^2), plus the bias.

    The support vectors are a fitted model of stated size and go into the plan
    as literals.
    """
    terms = [a * F.exp(-gamma * pixel.squared_l2(F.col("e"), F.array(*[F.lit(float(x)) for x in s]))) for s, a in support]
    total = F.lit(float(bias))
    for t in terms:
        total = total + t
    return vectors.select("vec_id", total.alias("score"))


def sign_bits(e: Column, dims: int = 64) -> Column:
    """Signs of up to 64 components as bits of a long, the first component lowest."""
    bit = lambda i: F.when(F.get(e, F.lit(i)) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    out = bit(0)
    for i in range(1, dims):
        out = out.bitwiseOR(bit(i))
    return out


def cross_check(matches: DataFrame, train: DataFrame, queries: DataFrame, metric: str) -> DataFrame:
    """Best matches (query_id, vec_id, distance) whose row's own best match among the queries is that query."""
    best = matches.where("rank = 1").select("query_id", "vec_id", "distance")
    hit = train.join(best.select("vec_id").distinct(), "vec_id", "left_semi")
    back = nearest(queries, hit, 1, metric).select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("query_id"))
    return best.join(back, ["query_id", "vec_id"], "left_semi").select("query_id", "vec_id", "distance")


def away_from_border(px: DataFrame, width: int, height: int, border: int) -> DataFrame:
    """Rows at least ``border`` cells inside the image."""
    return px.where((F.col("x") >= border) & (F.col("x") + border < width) & (F.col("y") >= border) & (F.col("y") + border < height))
