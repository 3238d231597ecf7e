"""Token ids in checksummed binary frames: write in document order, read back.

The store is a Parquet table in the shared folder, so that Spark's committer
makes each part whole or absent, whichever executors are lost. A row is one
frame: the ids of consecutive documents, cut into blocks that are coded alone
(``context_coder``; Spark's tasks run the same loops compiled, ``frame_coder``).
Layout of a frame, little-endian:

    magic "TIDF", version u32, documents u32, ids u64, ids of a block u32,
    blocks u32, crc32 of all that follows u32,
    doc_id i64 [documents], known u8 [documents] (0: null id), n_tokens u32 [documents],
    bytes u32 [blocks], crc32 of the block's ids u32 [blocks],
    the blocks' coded bytes

Between Python and the coder goes a plain frame: magic "TIDP", no blocks, no
crc32, and behind the documents' columns the ids as u16.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import context_coder, frame_coder
from tessella.llm import tokenizer_files as tf
from tessella.llm.bpe_automaton import tokenizer_bytes
from tessella.llm.common import map_texts, shared_dir, ship

_HEAD = struct.Struct("<4sIIQIII")
#: A frame is closed once it has this many ids; its last document is whole.
FRAME_IDS = 3_000_000
#: Distinct chunks of text that a worker remembers.
CHUNKS = 1_500_000
#: New chunks that the library gets in one text.
JOINED = 1000
#: Texts that are cut into chunks together, and their bytes, unless the first alone has more.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_STORE_SCHEMA = "pid int, seq int, n_tokens long, frame binary"


class IdEncoder:
    """Ids of whole texts as the ``tokenizers`` library gives them, a batch of texts at a time.

    No piece of a byte-level vocabulary crosses a cut in front of a space, but
    for runs of white space. So texts are cut there, Arrow gives each distinct
    chunk a number, and the library sees each chunk once; chunks are remembered
    until there are ``CHUNKS`` of them, or many long ones. Chunks that are new go to the library
    many in one text, and are told apart by the spaces they begin with. Texts
    that a cut would change, and texts that spell a special token, go to the
    library whole.
    """

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        file = tf.parse(raw)
        if file.word_level or any(i >= 1 << 16 for i in file.vocab.values()):
            raise ValueError("the store takes byte-level vocabularies with ids below 65536")
        self.library = Tokenizer.from_buffer(raw)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = list(file.specials)
        space = tf.byte_symbols()[ord(" ")]
        self.spaced = np.zeros(1 << 16, bool)
        self.spaced[[i for piece, i in file.vocab.items() if piece.startswith(space)]] = True
        self._forget()

    def _forget(self) -> None:
        # chunks behind a space, and those a text begins with
        self.known: tuple[dict[str, int], dict[str, int]] = {}, {}
        self.ids = np.zeros(1 << 16, "<u2")
        self.first, self.length = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.ends: dict[int, int] = {}
        self.used = self.entries = 0

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of new entries, whose ids follow each other."""
        total, n = self.used + len(ids), self.entries + len(lengths)
        while total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n > len(self.first):
            self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length))
        self.ids[self.used : total] = ids
        self.first[self.entries : n] = self.used + np.cumsum(lengths) - lengths
        self.length[self.entries : n] = lengths
        out = np.arange(self.entries, n)
        self.used, self.entries = total, n
        return out

    def _add(self, texts: list[str]) -> np.ndarray:
        """Numbers of new entries with the ids of some texts."""
        parts = [np.array(e.ids, "<u2") for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return self._keep(np.concatenate([*parts, np.zeros(0, "<u2")]), np.array([len(p) for p in parts], np.int64))

    def _add_spaced(self, chunks: list[str]) -> np.ndarray:
        """The same for chunks without a space, each behind one."""
        white = tf.WHITE_CHARS
        alone = [not c or c[0] in white or c[-1] in white for c in chunks]
        if any(special in c for special in self.specials for c in chunks):
            alone = [a or any(special in c for special in self.specials) for a, c in zip(alone, chunks, strict=True)]
        out = np.zeros(len(chunks), np.int64)
        at = np.flatnonzero(alone)
        out[at] = self._add([" " + chunks[i] for i in at.tolist()])
        at = np.flatnonzero(~np.array(alone, bool))
        groups = [at[lo : lo + JOINED] for lo in range(0, len(at), JOINED)]
        texts = [" " + " ".join([chunks[i] for i in g.tolist()]) for g in groups]
        for group, e in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u2")
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) == len(group):
                out[group] = self._keep(ids, np.diff(begins, append=len(ids)))
            else:
                # a vocabulary in which some piece has a space elsewhere
                out[group] = self._add([" " + chunks[i] for i in group.tolist()])
        return out

    def _numbers(self, chunks: list[str], head: bool) -> np.ndarray:
        """The entries of distinct chunks; what isn't known yet is encoded together."""
        known = self.known[head]
        out = np.fromiter(map(known.get, chunks, repeat(-1)), np.int64, len(chunks))
        at = np.flatnonzero(out < 0)
        if len(at):
            new = [chunks[i] for i in at.tolist()]
            out[at] = numbers = (self._add if head else self._add_spaced)(new)
            if max(map(len, new)) <= 64:
                known.update(zip(new, numbers.tolist(), strict=True))
            else:
                known.update((c, i) for c, i in zip(new, numbers.tolist(), strict=True) if len(c) <= 64)
        return out

    def _end(self, end: int) -> int:
        """Where the id ``end`` stands alone."""
        if end not in self.ends:
            self.ends[end] = int(self.first[self._keep(np.array([end], "<u2"), np.array([1]))[0]])
        return self.ends[end]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with ``end`` behind it if that is given, and how many each has."""
        if self.entries > CHUNKS or self.used > 10 * CHUNKS:
            self._forget()
        n = len(texts)
        if not n:
            return np.zeros(0, "<u2"), np.zeros(0, np.int64)
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        chunks = cut.flatten().dictionary_encode()
        distinct, which = chunks.dictionary, chunks.indices.to_numpy()
        # no chunk holds a space; one string that is split makes them faster than to_pylist
        names = pc.binary_join(pa.LargeListArray.from_arrays([0, len(distinct)], distinct), " ")[0].as_py().split(" ")
        first, last = offsets[:-1], offsets[1:] - 1
        # white space, a space and white space in a row: a cut would part what belongs together
        opens, closes, empty = (x[which] for x in _white_ends(distinct, names))
        before, behind = closes | empty, opens | empty
        before[first], behind[last] = closes[first], opens[last]
        joined = before[:-1] & behind[1:]
        joined[last[:-1]] = False
        whole = np.add.reduceat(np.append(joined, False), first) > 0
        for special in self.specials:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        heads = np.zeros(len(which), bool)
        heads[first] = True
        met = np.zeros((2, len(names)), bool)
        met[0][which[~heads]] = True
        met[1][which[first]] = True
        lookup = np.zeros((2, len(names)), np.int64)
        for head in (False, True):
            at = np.flatnonzero(met[int(head)])
            lookup[int(head)][at] = self._numbers([names[i] for i in at.tolist()], head)
        entry = lookup[0][which]
        entry[first] = lookup[1][which[first]]
        length = self.length[entry]
        at = np.flatnonzero(whole)
        if len(at):
            length[np.repeat(whole, np.diff(offsets))] = 0
            entry[first[at]] = self._add([texts[i].as_py() for i in at.tolist()])
            length[first[at]] = self.length[entry[first[at]]]
        counts = np.add.reduceat(length, first, dtype=np.int64)
        begins = self.first[entry]
        if end is not None:
            # one more chunk behind each text
            at = last + 1
            begins, length = np.insert(begins, at, self._end(end)), np.insert(length, at, 1)
            counts += 1
        ends = np.cumsum(length, dtype=np.int64)
        place = np.repeat(begins - (ends - length), length)
        place += np.arange(len(place))
        return self.ids.take(place), counts


def _white_ends(chunks: pa.StringArray, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which chunks begin with white space, end with it, and are empty. Bytes tell of most that they don't."""
    offsets = np.frombuffer(chunks.buffers()[1], np.int32, len(chunks) + 1, chunks.offset * 4)
    held = chunks.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(1, np.uint8)
    empty = offsets[1:] == offsets[:-1]
    out = []
    for i, at in ((0, offsets[:-1]), (-1, offsets[1:] - 1)):
        white = _WHITE_ENDS[i][data[np.clip(at, 0, len(data) - 1)]] & ~empty
        maybe = np.flatnonzero(white)
        white[maybe] = [names[k][i] in tf.WHITE_CHARS for k in maybe.tolist()]
        out.append(white)
    return out[0], out[1], empty


#: For each byte, whether some white space begins (0) or ends (-1) with it.
_WHITE_ENDS = {i: np.isin(np.arange(256), [c.encode()[i] for c in tf.WHITE_CHARS]) for i in (0, -1)}


@lru_cache(maxsize=4)
def id_encoder(raw: bytes) -> IdEncoder:
    return IdEncoder(raw)


def _columns(doc_ids: list[int | None], counts: np.ndarray) -> bytes:
    known = np.array([i is not None for i in doc_ids], np.uint8)
    return np.array([i or 0 for i in doc_ids], "<i8").tobytes() + known.tobytes() + counts.astype("<u4").tobytes()


def _head(frame: bytes, magic: bytes) -> tuple[int, ...]:
    found, version, *numbers = _HEAD.unpack_from(frame)
    if found != magic or version != 2:
        raise ValueError("damaged frame")
    return tuple(numbers)


def _documents(body: memoryview, n: int) -> tuple[list[int | None], np.ndarray]:
    doc_ids, known, counts = np.frombuffer(body, "<i8", n), np.frombuffer(body, "u1", n, 8 * n), np.frombuffer(body, "<u4", n, 9 * n)
    return [i if k else None for i, k in zip(doc_ids.tolist(), known.tolist(), strict=True)], counts


def plain_frame(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One plain frame of whole documents: how many 16-bit ids each has, and all of them."""
    return b"".join([_HEAD.pack(b"TIDP", 2, len(doc_ids), len(ids), context_coder.BLOCK, 0, 0), _columns(doc_ids, counts), ids.astype("<u2").tobytes()])


def read_plain(frame: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids of each document, and all ids."""
    n_docs, n_ids, *_ = _head(frame, b"TIDP")
    body = memoryview(frame)[_HEAD.size :]
    return *_documents(body, n_docs), np.frombuffer(body, "<u2", n_ids, 13 * n_docs)


def pack_frame(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One coded frame, without Spark."""
    coded, checks = context_coder.encode_blocks(ids)
    body = b"".join([_columns(doc_ids, counts), np.array([len(c) for c in coded], "<u4").tobytes(), checks.astype("<u4").tobytes(), *coded])
    return _HEAD.pack(b"TIDF", 2, len(doc_ids), len(ids), context_coder.BLOCK, len(coded), zlib.crc32(body)) + body


def unpack_frame(frame: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids of each document, and all ids of a coded frame, without Spark; raises ValueError on damage."""
    n_docs, n_ids, block, blocks, check = _head(frame, b"TIDF")
    body = memoryview(frame)[_HEAD.size :]
    if zlib.crc32(body) != check:
        raise ValueError("damaged frame")
    at = 13 * n_docs
    sizes, checks = np.frombuffer(body, "<u4", blocks, at), np.frombuffer(body, "<u4", blocks, at + 4 * blocks)
    ends = at + 8 * blocks + np.cumsum(sizes, dtype=np.int64)
    coded = [bytes(body[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    lengths = np.minimum(block, n_ids - np.arange(blocks, dtype=np.int64) * block)
    return *_documents(body, n_docs), context_coder.decode_blocks(coded, lengths, checks)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, small batches together."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if held and (rows + len(batch) > BATCH_ROWS or size + batch.nbytes > BATCH_BYTES):
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
        held.append(batch)
        rows, size = rows + len(batch), size + batch.nbytes
    if held:
        yield pa.concat_batches(held)


def write_ids(docs: DataFrame, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, frame_ids: int = FRAME_IDS) -> str:
    """Encode every whole text, append ``end_id``, and write frames in ascending id order.

    Null ids come first, a null text is only its end id, and rows with one id
    are ordered by a hash of their text, so one id that holds many rows can be
    dealt to several tasks. Other columns are not read. Returns the folder.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark, "ids")
    sent = spark.sparkContext.broadcast(tokenizer_bytes(tokenizer))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = slim.repartitionByRange("id", "h").sortWithinPartitions("id", "h")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tasks run side by side already; the library's own threads would each keep memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder, pid, seq = id_encoder(sent.value), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        held_counts: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal names, held, held_counts, size, seq
            packed = plain_frame(names, np.concatenate(held_counts), np.concatenate(held))
            frame = pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([packed], pa.binary())], ["pid", "seq", "n_tokens", "frame"])
            names, held, held_counts, size, seq = [], [], [], 0, seq + 1
            return frame

        for batch in _gathered(batches):
            ids, counts = encoder.encode(batch.column(1), end_id)
            own, ends, lo = batch.column(0).to_pylist(), np.cumsum(counts), 0
            while lo < len(own):
                before = int(ends[lo - 1]) if lo else 0
                # up to the document with which the frame is full
                hi = min(len(own), int(np.searchsorted(ends, before + frame_ids - size)) + 1)
                names += own[lo:hi]
                held.append(ids[before : int(ends[hi - 1])])
                held_counts.append(counts[lo:hi])
                size += int(ends[hi - 1]) - before
                lo = hi
                if size >= frame_ids:
                    yield flush()
        if names:
            yield flush()

    frames = map_texts(dealt, ["id", "text"], work, _STORE_SCHEMA)
    frames.withColumn("frame", frame_coder.coded(spark, "frame")).write.parquet(path)
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a store: ``doc_id``, ``start`` (ids before it), ``n_tokens`` and ``ids`` (binary, 32-bit little-endian).

    The driver holds one number for each part of the store, never one for each document.
    """
    return _read(spark, path, "ids binary", lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_ids``, with ``ids_crc32`` in place of the ids."""
    return _read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4")), pa.int64())


def _read(spark: SparkSession, path: str, column: str, value, kind: pa.DataType) -> DataFrame:
    ship(spark)
    frames = spark.read.schema(_STORE_SCHEMA).parquet(path)
    totals = {r.pid: r.n for r in frames.groupBy("pid").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, before = {}, 0
    for pid in sorted(totals):
        starts[pid] = before
        before += totals[pid]
    # where each frame starts: few frames in a part, so a self-join on the part is small
    a, b = frames.select("pid", "seq", "n_tokens").alias("a"), frames.select("pid", "seq").alias("b")
    known = b.join(a, (F.col("a.pid") == F.col("b.pid")) & (F.col("a.seq") < F.col("b.seq")), "left")
    inside = known.groupBy("b.pid", "b.seq").agg(F.coalesce(F.sum("a.n_tokens"), F.lit(0)).alias("inside"))
    sent = spark.sparkContext.broadcast(json.dumps(starts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = {int(k): v for k, v in json.loads(sent.value).items()}
        for batch in batches:
            for pid, inner, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                names, counts, ids = read_plain(frame.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                first = ends - counts
                values = [value(ids[s:e]) for s, e in zip(first.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(first + base[pid] + inner), pa.array(counts.astype(np.int64)), pa.array(values, kind)], ["doc_id", "start", "n_tokens", column.split()[0]])


    return frames.select("pid", "seq", "frame").join(inside, ["pid", "seq"]).select("pid", "inside", frame_coder.plain(spark, "frame").alias("frame")).mapInArrow(work, f"doc_id long, start long, n_tokens long, {column}")
