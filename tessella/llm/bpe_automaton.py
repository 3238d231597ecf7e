"""BPE encoding and decoding through a token automaton.

The merges of a BPE file are compiled, in rank order, into a deterministic
automaton over token labels that accepts exactly the sequences which BPE
produces. It starts as one state per base symbol with every arc allowed. The
merge gadget for rule ``(a, b) -> c``

* gives every state with an arc ``a`` an arc ``c`` as well,
* lets the arcs ``c`` lead to a copy of the state after ``b``, and
* removes the arc ``b`` from the state after ``a``.

All arcs with one label lead to one state, so a state is named by the label
that led to it. A full table has |V|^2 cells; the gadgets are therefore kept as
copy-on-write records (which row and which column was copied, when, and which
cell was cut), and a transition is resolved through them once and then kept in
the transition table.

Encoding walks the table: of the tokens that spell the next symbols, longest
first, it takes one that the state has an arc for, and steps back where none is
left. A prefix has only one accepted sequence, so no position is tried twice.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import tokenizer_files as tf
from tessella.llm.common import map_texts

_LATEST = 1 << 30
#: Transitions that are kept resolved; with more, all are forgotten and resolved anew.
TRANSITIONS = 2_000_000


class TokenAutomaton:
    """The compiled automaton of one BPE file."""

    def __init__(self, file: tf.BpeFile):
        self.file = file
        n = max(file.vocab.values(), default=-1) + 1
        self.labels = [""] * n
        for label, i in file.vocab.items():
            self.labels[i] = label
        self.labels_of_specials = {i: s for s, i in file.specials.items()}
        self.born = [-1] * n
        self.row_from = [0] * n
        self.arc_from = [0] * n
        self.cut: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        self.longest = max(map(len, file.vocab), default=1)
        for rank, (a, b) in enumerate(file.merges):
            self._gadget(rank, file.vocab[a], file.vocab[b], file.vocab[a + b])
        symbols = tf.byte_symbols()
        self.as_symbols = {i: s for i, s in enumerate(symbols)}
        self.pieces = tf.WORD_PIECES if file.word_level else tf.BYTE_PIECES

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        self.born[c], self.arc_from[c], self.row_from[c] = rank, a, b
        self.cut.setdefault(a << 20 | b, rank)

    def _resolve(self, state: int, label: int) -> bool:
        born, cut, before = self.born, self.cut, _LATEST
        while True:
            at = cut.get(state << 20 | label)
            if at is not None and at < before:
                return False
            s, y = born[state], born[label]
            if s < 0 and y < 0:
                return True
            if y > s:
                # the arc was copied as the gadget left it
                label, before = self.arc_from[label], y + 1
            elif s > y:
                # the state was copied as the gadget found it
                state, before = self.row_from[state], s
            else:
                state, label, before = self.row_from[state], self.arc_from[label], s

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one piece as the pre-tokenizer gives it."""
        text = piece.translate(self.as_symbols) if piece.isascii() else "".join(self.as_symbols[b] for b in piece.encode())
        vocab, suffix, table, longest = self.file.vocab, self.file.suffix, self.table, self.longest
        if len(table) > TRANSITIONS:
            table.clear()
        n, at, out, ends = len(text), 0, [], []
        dead = bytearray(n + 1)
        upto = min(n, longest)
        while at < n:
            found = -1
            while upto > at:
                if not dead[upto]:
                    token = vocab.get(text[at:upto] + suffix if upto == n else text[at:upto])
                    if token is not None:
                        if not out:
                            found = token
                            break
                        key = out[-1] << 20 | token
                        ok = table.get(key)
                        if ok is None:
                            ok = table[key] = self._resolve(out[-1], token)
                        if ok:
                            found = token
                            break
                upto -= 1
            if found >= 0:
                out.append(found)
                ends.append(at)
                at = upto
                upto = min(n, at + longest)
            else:
                dead[at] = 1
                if not out:
                    raise ValueError(f"no token sequence spells {piece[:40]!r}")
                upto, at = at - 1, ends.pop()
                out.pop()
        return out

    def segments(self, text: str) -> Iterator[tuple[str, int]]:
        """Runs of plain text, and special tokens by id."""
        pattern = self.file.special_pattern
        if pattern is None or not any(s in text for s in self.file.specials):
            yield text, -1
            return
        for part in pattern.split(text):
            if part in self.file.specials:
                yield part, self.file.specials[part]
            elif part:
                yield part, -1

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.segments(text):
            if special >= 0:
                out.append(special)
                continue
            for chunk in tf.word_chunks(part) if self.file.word_level else [part]:
                for piece in self.pieces.findall(chunk):
                    out += self.encode_piece(piece)
        return out

    def label(self, i: int) -> str:
        return self.labels_of_specials[i] if i in self.labels_of_specials else self.labels[i]

    def decode(self, ids: list[int]) -> str:
        """Emit arc labels: joined by spaces for vocabularies of words, as bytes for byte-level ones."""
        if self.file.word_level:
            return " ".join(map(self.label, ids))
        of = {s: i for i, s in enumerate(tf.byte_symbols())}
        raw = b"".join(self.labels_of_specials[i].encode() if i in self.labels_of_specials else bytes(of[c] for c in self.labels[i]) for i in ids)
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def automaton(raw: bytes) -> TokenAutomaton:
    """The automaton of a tokenizer file, compiled once in each Python worker."""
    return TokenAutomaton(tf.parse(raw))


@lru_cache(maxsize=4)
def _digest_memos(raw: bytes) -> tuple[tf.Memo, tf.Memo]:
    """For chunks without white space: ids as text, and decoded text."""
    auto = automaton(raw)

    def spelled(piece: str) -> tuple[str, str]:
        ids = auto.encode_piece(piece)
        return " ".join(map(str, ids)), auto.decode(ids)

    pieces, kept = tf.Memo(spelled), {}

    def as_text(chunk: str) -> str:
        got = [pieces[p] for p in auto.pieces.findall(chunk)]
        if len(kept) > 10_000:
            kept.clear()
        kept[chunk] = " ".join([g[1] for g in got])
        return " ".join([g[0] for g in got])

    def decoded(chunk: str) -> str:
        return kept.pop(chunk, None) or " ".join([pieces[p][1] for p in auto.pieces.findall(chunk)])

    return tf.Memo(as_text), tf.Memo(decoded)


def forget_chunks() -> None:
    """Drop the chunks that this Python worker remembers; automata stay."""
    _digest_memos.cache_clear()
    gc.collect()  # memos and the functions that fill them refer to each other


def encode_digest(raw: bytes, text: str | None) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids as text, SHA-256 of the decoded text."""
    auto, (memo, shown) = automaton(raw), _digest_memos(raw)
    ids: list[str] = []
    labels: list[str] = []
    for part, special in auto.segments(text or ""):
        if special >= 0:
            ids.append(str(special))
            labels.append(auto.label(special))
        elif chunks := tf.word_chunks(part):
            ids.append(" ".join(map(memo.__getitem__, chunks)))
            labels.append(" ".join(map(shown.__getitem__, chunks)))
    joined = " ".join(ids)
    n = joined.count(" ") + 1 if joined else 0
    return n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(" ".join(labels).encode()).hexdigest()


def tokenizer_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text; one row for each row of ``docs``: its id and ``ids`` (array of int).

    A null text has no ids, as an empty one. Null ids and repeated rows stay as
    they are; other columns are not read. The file at ``tokenizer`` is read on
    the driver and sent to the executors.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_bytes(tokenizer))

    def work(batches):
        auto = automaton(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([auto.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text")], work, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, tokenizer: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode id arrays, special tokens included; a null array gives null."""
    sent = encoded.sparkSession.sparkContext.broadcast(tokenizer_bytes(tokenizer))

    def work(batches):
        auto = automaton(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if ids is None else auto.decode(ids) for ids in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_texts(encoded, [F.col(id_col).alias("id"), F.col(ids_col).alias("ids")], work, f"id {kind}, text string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Encode and decode every whole text, and keep what identifies the two results.

    Returns the id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, one row
    for each input row. A null text counts as empty: no ids, and the digests of
    nothing. Needs a vocabulary of words (white space dropped).

    Chunks are remembered by Python workers, which Spark hands on to whatever
    runs next. Without ``keep`` each task forgets them at its end: the next one
    spells its chunks anew, but other stages don't hold that memory.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_bytes(tokenizer))
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        raw = sent.value
        try:
            for batch in batches:
                n, ids, decoded = [], [], []
                for text in batch.column(1):
                    a, b, c = encode_digest(raw, text.as_py())
                    n.append(a), ids.append(b), decoded.append(c)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            if not keep:
                forget_chunks()

    out = map_texts(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text")], work, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)

