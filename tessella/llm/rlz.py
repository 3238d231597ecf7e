"""Repeated passages by relative Lempel-Ziv parsing against distributed reference blocks.

The corpus is its own reference. Documents are cut into phrases by content, so
that they agree about them wherever they agree about the text: among the
``KGRAM``-word runs of each window of ``window`` words, the one with the least
hash is the window's anchor. All windows with one anchor are consecutive;
together they are the anchor's phrase. A factor of ``window`` words or more
shares an anchor with the text it is copied from, so the reference is dealt to
blocks by anchor, and a phrase has to be parsed against its anchor's block
alone: no other can hold a long factor of it.

A phrase that an earlier document has as a whole is one factor. All others, of
anchors that have several phrases, are parsed greedily: a block holds the texts
of its phrases, one for each first occurrence, with an index of their windows.
Where the next ``window`` words are in the index under an earlier document, the
factor goes on for as long as the two texts agree, word by word. Parsing
resumes at the first window that the factor's end cuts, so no window at a
boundary is left out.

An anchor with more phrases than a block should hold has its windows dealt out
one by one, each to the block of its own hash.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import xx64
from tessella.llm.common import forget, map_texts, marked, passed, stored

WINDOW = 50
KGRAM = 12
#: Phrases of one anchor that a block holds at most; with more, windows are dealt out one by one.
BLOCK_PHRASES = 2000
#: Bits of the filters that are sent to all executors: 4 MB.
FILTER_BITS = 1 << 25
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_LAST = (1 << 63) - 1


class WordHashes:
    """Hashes of any runs of a text's words, from sums over its prefixes."""

    def __init__(self, text: str | None):
        raw = text.encode() if text else b""
        self.words = raw.split()
        joined = b" ".join(self.words)
        self.n = len(self.words)
        if not self.n:
            return
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        starts = np.concatenate([[0], gaps + 1])
        h = xx64.hash_ranges(joined, starts, np.append(gaps, len(joined)) - starts)
        self.sums, self.back = [], []
        with np.errstate(over="ignore"):
            for base in _BASES:
                up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, base, np.uint64)]))
                inverse = np.uint64(pow(base, -1, 1 << 64))
                self.back.append(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, inverse, np.uint64)])))
                self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1])]))
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        """One of two independent hashes of the words ``starts`` to ``ends`` (exclusive)."""
        with np.errstate(over="ignore"):
            x = (self.sums[which][ends] - self.sums[which][starts]) * self.back[which][starts]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
        return x.view(np.int64)

    def phrases(self, window: int, kgram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor hash, first and last window of each phrase."""
        windows = self.n - window + 1
        if windows < 1:
            return (np.zeros(0, np.int64),) * 3
        runs = self.of(np.arange(self.n - kgram + 1), np.arange(kgram, self.n + 1), 0)
        view = np.lib.stride_tricks.sliding_window_view(runs, window - kgram + 1)
        anchors = np.concatenate([view[s : s + 65536].argmin(axis=1) + np.arange(s, min(s + 65536, windows)) for s in range(0, windows, 65536)])
        first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        return runs[anchors[first]], first, np.append(first[1:], windows) - 1


def _parse(window: int, kgram: int):
    names = ["doc", "th", "anchor", "s1", "s2", "lo", "hi"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in names]
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                hashes = WordHashes(text.as_py())
                anchor, lo, hi = hashes.phrases(window, kgram)
                if len(lo):
                    ends = hi + window
                    for p, x in zip(parts, (np.full(len(lo), doc), np.full(len(lo), th), anchor, hashes.of(lo, ends, 0), hashes.of(lo, ends, 1), lo, hi), strict=True):
                        p.append(x)
            if parts[0]:
                cut = [np.concatenate(p) for p in parts]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cut[:5]), *(pa.array(c.astype(np.int32)) for c in cut[5:])], names)

    return work


def _pieces(window: int):
    """What ``spans`` lists of each text, for the blocks: texts of phrases by anchor, or hashes of single windows."""
    names = ["key", "w2", "doc", "th", "lo", "words"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, w2, docs, ths, los, words = ([] for _ in names)
            for doc, th, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                hashes = WordHashes(text.as_py())
                for x in spans:
                    if x["single"]:
                        s = np.arange(x["lo"], x["hi"] + 1)
                        key += hashes.of(s, s + window, 0).tolist()
                        w2 += hashes.of(s, s + window, 1).tolist()
                        los += s.tolist()
                        words += [None] * len(s)
                    else:
                        key.append(x["anchor"]), w2.append(None), los.append(x["lo"])
                        words.append(b" ".join(hashes.words[x["lo"] : x["hi"] + window]))
                docs += [doc] * (len(key) - len(docs))
                ths += [th] * (len(key) - len(ths))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(w2, pa.int64()), pa.array(docs, pa.int64()), pa.array(ths, pa.int64()), pa.array(los, pa.int32()), pa.array(words, pa.binary())], names)

    return work


class Block:
    """A reference block: phrases of one anchor as they come, in the order of their documents."""

    def __init__(self, window: int):
        self.window = window
        #: Where each window first occurs: document, phrase, place.
        self.index: dict[bytes, tuple[int, list[bytes], int]] = {}

    def factors(self, doc: int, phrase: bytes) -> list[tuple[int, int]]:
        """Parse a phrase greedily against all earlier documents' phrases; first and last window of each factor. Adds what is new."""
        words, window, index = phrase.split(b" "), self.window, self.index
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        out, at, windows = [], 0, len(words) - window + 1
        while at < windows:
            seed = phrase[starts[at] : ends[at + window - 1] - 1]
            known = index.get(seed)
            if known is None:
                index[seed] = doc, words, at
            elif known[0] < doc:
                _, other, place = known
                length, most = window, min(len(words) - at, len(other) - place)
                while length < most and words[at + length] == other[place + length]:
                    length += 1
                out.append((at, at + length - window))
                at += length - window
            at += 1
        return out


def _factored(window: int):
    """Rows of one anchor come together, by document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, Block(window)
        for batch in batches:
            docs, ths, los, his = [], [], [], []
            for key, doc, th, lo, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    last, block = key, Block(window)
                for a, b in block.factors(doc, words):
                    docs.append(doc), ths.append(th), los.append(lo + a), his.append(lo + b)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ths, pa.int64()), pa.array(los, pa.int32()), pa.array(his, pa.int32())], ["doc", "th", "lo", "hi"])

    return work


def _cover(n: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which of ``n`` words lie in removed windows, given by first and last window."""
    edges = np.zeros(n + 1, np.int64)
    for x in spans or ():
        edges[x["lo"]] += 1
        edges[min(x["hi"] + window, n)] -= 1
    return np.cumsum(edges[:-1]) > 0


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Null ids count as larger than all others; rows are told apart by id and a hash of their text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def _place() -> Column:
    return F.pmod(F.xxhash64("doc", "th"), F.lit(FILTER_BITS)).alias("place")


def duplicate_spans(docs: DataFrame, *, window: int = WINDOW, kgram: int = KGRAM, id_col: str = "doc_id", text_col: str = "text", block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """Runs of duplicate windows: ``doc``, ``th`` and ``spans``, an array of (lo, hi), first and last window.

    A window is a duplicate if a document with a smaller id has the same words
    in a row. Documents without one have no row.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    phrases = stored(map_texts(keyed, ["doc", "th", "text"], _parse(window, kgram), "doc long, th long, anchor long, s1 long, s2 long, lo int, hi int"), "phrases")
    # the reference: each phrase once, with the first and last document that has it
    index = stored(phrases.groupBy("s1", "s2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.first("anchor").alias("anchor")), "index")
    # anchors with different phrases, in more than one document
    split = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("least"), F.max("last").alias("most")).where("n > 1 and least < most").select("anchor", F.col("n").alias("split"))
    useful = index.join(split, "anchor", "left").where("split is not null or first < last").select("s1", "s2", "first", "split")
    met = stored(phrases.join(useful, ["s1", "s2"]).where("first < doc or split is not null").select("doc", "th", "anchor", "lo", "hi", "first", "split"), "met")
    forget(phrases, index)
    whole = met.where("first < doc").select("doc", "th", "lo", "hi")
    # first occurrences whose anchor has other phrases too: what blocks hold, and what they parse
    open_ = stored(met.where("first = doc").groupBy("doc", "th").agg(F.collect_set(F.struct("lo", "hi", "anchor", (F.col("split") > block_phrases).alias("single"))).alias("spans")), "open")
    bits = spark.sparkContext.broadcast(marked(open_.select(_place()), FILTER_BITS))
    texts = passed(keyed, _place(), bits).join(open_.hint("shuffle_hash"), ["doc", "th"])
    pieces = stored(map_texts(texts, ["doc", "th", "text", "spans"], _pieces(window), "key long, w2 long, doc long, th long, lo int, words binary"), "pieces")
    blocks = pieces.where("w2 is null").select("key", "doc", "th", "lo", "words").repartition("key").sortWithinPartitions("key", "doc")
    factors = blocks.mapInArrow(_factored(window), "doc long, th long, lo int, hi int")
    single = pieces.where("w2 is not null")
    first = single.groupBy("key", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    alone = single.join(first, ["key", "w2"]).where("first < doc").select("doc", "th", "lo", F.col("lo").alias("hi"))
    out = stored(whole.union(factors).union(alone).groupBy("doc", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    forget(met, open_, pieces)
    return out


def _clean(window: int, keep_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = _cover(len(words), spans.as_py(), window)
                n_words.append(len(words)), n_removed.append(int(gone.sum()))
                rest = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n_removed[-1] else words)
                kept.append(rest.decode() if keep_text else hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return work


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, kgram: int = KGRAM, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text", block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """Remove every word in a window of ``window`` words that an earlier document has too.

    Returns one row for each input row: the id, ``n_words``, ``n_removed`` and
    ``kept``: the words left, joined by one space, or with
    ``keep_text=False`` their SHA-256. Windows are judged on the input. A null
    text has no words. Rows with one id don't count as earlier than each other;
    a null id counts as later than all others. Other columns are not read.

    Documents without a span don't move; a filter of fixed size tells which
    may have one, and only those are joined with their spans.
    """
    spans = duplicate_spans(docs, window=window, kgram=kgram, id_col=id_col, text_col=text_col, block_phrases=block_phrases)
    keyed, bits = _keyed(docs, id_col, text_col), docs.sparkSession.sparkContext.broadcast(marked(spans.select(_place()), FILTER_BITS))
    none = F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("spans")
    joined = passed(keyed, _place(), bits).join(spans.hint("shuffle_hash"), ["doc", "th"], "left")
    out = [map_texts(df, [F.nullif("doc", F.lit(_LAST)).alias("id"), "text", s], _clean(window, keep_text), "id long, n_words long, n_removed long, kept string") for df, s in ((passed(keyed, _place(), bits, False), none), (joined, "spans"))]
    return out[0].union(out[1]).withColumnRenamed("id", id_col)
