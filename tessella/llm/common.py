"""What several text operators share: word rules, shipping code, shared tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the five ASCII controls TAB to CR. ``bytes.split`` uses the same six.
SEPARATORS = " \t\n\x0b\x0c\r"
_SEPARATOR_CLASS = "[ \\t\\n\\x0B\\f\\r]"

#: Rows of whole texts that are worked on together; texts can be long, so it stays low. Spark bounds the bytes that it sends at once.
TEXT_ROWS = 500

_SHIPPED: set[str] = set()


def words_of(text: str | None) -> list[str]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return [w.decode() for w in text.encode().split()] if text else []


def word_array(text: Column) -> Column:
    """The same words as a native array column."""
    parts = F.split(F.coalesce(text, F.lit("")), _SEPARATOR_CLASS + "+")
    return F.filter(parts, lambda w: w != "")


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that lack it, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    out = Path(tempfile.mkdtemp(prefix="tessella-")) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, or below the checkpoint folder that the context was given.

    Where neither is set and Spark runs in one process, as in tests, a temporary
    folder is set; on a cluster that would lose rows with their machine, so
    there it is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = sc._jsc.sc().getCheckpointDir()
        if given.isDefined():
            base = given.get()
        elif sc.master.startswith("local") and "cluster" not in sc.master:
            base = f"file://{tempfile.gettempdir()}/tessella-shared"
            sc.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/tessella-{what}-{os.getpid()}-{uuid.uuid4().hex}"


_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: the rows as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` that nothing reads any more."""
    for df in tables:
        path = _FOLDERS.pop(df, None)
        if path is not None:
            jvm = df.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of queries that are done: it does so when nothing refers to them any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, what: str, *order: str | Column) -> tuple[DataFrame, list[int]]:
    """The rows in order, spread over many tasks: a stored table with ``part`` and ``own``, the place in the part.

    Also gives how many rows come before each part, one number for each. A
    row's place among all is ``own`` and what comes before its part.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    out = stored(sorted_.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("own")), what)
    sizes = {r.part: r.n for r in out.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(at)
        at += sizes.get(p, 0)
    return out, before


def listed(numbers: Sequence[float | None], at: Column, kind: str = "double") -> Column:
    """Entry ``at`` of a list that goes into the plan as one constant; null outside and for None."""
    if not len(numbers):
        return F.lit(None).cast(kind)
    got = F.get(F.split(F.lit(",".join("NaN" if x is None else repr(x) for x in numbers)), ",").cast(f"array<{kind}>"), at.cast("int"))
    return F.when(~F.isnan(got), got) if kind == "double" else got


def sized(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``, whatever size Spark sends them in."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for lo in range(0, len(batch), rows):
            part = batch.slice(lo, rows)
            held.append(part)
            n += len(part)
            if n >= rows:
                yield pa.concat_batches(held)
                held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def marked(places: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of ``bits`` places, set for those in the column ``place``: of one size, however many rows there are.

    Executors pack the bits, so the driver gets a few large rows.
    """
    chunk = 1 << 12
    words = places.select(F.shiftright("place", 6).alias("at"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(at // chunk).tolist():
                own = at // chunk == p
                held.setdefault(p, np.zeros(chunk, np.int64))[at[own] - p * chunk] = x[own]
        for p, packed in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([packed.tobytes()], pa.binary())], ["p", "x"])

    ship(places.sparkSession)
    out = np.zeros(bits // 64, np.int64)
    dealt = words.groupBy("at").agg(F.bit_or("bit").alias("x")).repartition(F.floor(F.col("at") / chunk)).select("at", "x")
    for r in dealt.mapInArrow(pack, "p long, x binary").toLocalIterator():
        out[r.p * chunk : (r.p + 1) * chunk] = np.frombuffer(r.x, np.int64)
    return out


def is_marked(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 6] >> (place & 63) & 1).astype(bool)


def passed(df: DataFrame, place: Column, bits, wanted: bool = True) -> DataFrame:
    """Rows whose place is set in a filter that was sent out, or is not. Other rows may share a place: what passes still has to be joined."""
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = is_marked(bits.value, batch.column("__place").to_numpy()) == wanted
            yield batch.select(names).filter(pa.array(keep))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_texts(df, [*names, place.alias("__place")], work, schema)


def map_texts(
    df: DataFrame,
    columns: list[str | Column],
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Run ``work`` over Arrow batches of whole texts, a bounded number of rows at a time."""
    ship(df.sparkSession)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(part for batch in batches for lo in range(0, len(batch), TEXT_ROWS) for part in [batch.slice(lo, TEXT_ROWS)])

    return df.select(*columns).mapInArrow(sliced, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
