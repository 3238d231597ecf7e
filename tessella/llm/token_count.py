"""Token counts without tokens: byte-pair merging on a heap and a linked list.

A piece starts as a linked list of base symbols. All adjacent pairs that have a
merge sit in a heap by rank, then by place. The lowest is popped, its two
symbols become one, and the pairs with the two neighbours enter the heap; an
entry whose pair has changed meanwhile is dropped. The count is the number of
initial symbols minus the merges done. No identifiers are put out.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import tokenizer_files as tf
from tessella.llm.bpe_automaton import tokenizer_bytes
from tessella.llm.common import map_texts

_PLACES = 40


class PairMerger:
    """The merges of one BPE file, by pair of symbols."""

    def __init__(self, raw: bytes):
        file = tf.parse(raw)
        self.file = file
        symbol = {s: i for i, s in enumerate(file.vocab)}
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(file.merges):
            self.merge.setdefault(symbol[a] << 20 | symbol[b], (rank, symbol[a + b]))
        of = tf.byte_symbols()
        self.base = [symbol[c] for c in of]
        self.base_last = [symbol[c + file.suffix] for c in of]
        self.pieces = tf.WORD_PIECES if file.word_level else tf.BYTE_PIECES
        by_piece = tf.Memo(self.count_piece)
        self.by_piece = by_piece
        self.by_chunk = tf.Memo(lambda chunk: sum([by_piece[p] for p in self.pieces.findall(chunk)]))
        #: A chunk that follows a space, without that space.
        self.after_space = tf.Memo(lambda chunk: sum([by_piece[p] for p in self.pieces.findall(" " + chunk)]))

    def count_piece(self, piece: str) -> int:
        raw = piece.encode()
        n = len(raw)
        if n < 2:
            return n
        base, merge = self.base, self.merge
        symbols = [base[b] for b in raw]
        symbols[-1] = self.base_last[raw[-1]]
        heap = []
        for i in range(n - 1):
            got = merge.get(symbols[i] << 20 | symbols[i + 1])
            if got is not None:
                heap.append(got[0] << _PLACES | i)
        if not heap:
            return n
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges, mask = 0, (1 << _PLACES) - 1
        while heap:
            entry = heappop(heap)
            i = entry & mask
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            got = merge.get(symbols[i] << 20 | symbols[j])
            if got is None or got[0] != entry >> _PLACES:
                continue
            merges += 1
            symbols[i], symbols[j] = got[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = merge.get(symbols[i] << 20 | symbols[k])
                if new is not None:
                    heappush(heap, new[0] << _PLACES | i)
            h = before[i]
            if h >= 0:
                new = merge.get(symbols[h] << 20 | symbols[i])
                if new is not None:
                    heappush(heap, new[0] << _PLACES | h)
        return n - merges

    def count(self, text: str) -> int:
        pattern, total = self.file.special_pattern, 0
        if pattern is not None and any(s in text for s in self.file.specials):
            parts = pattern.split(text)
            total += len(parts) // 2
            texts = parts[::2]
        else:
            texts = [text]
        for part in texts:
            if self.file.word_level:
                total += sum(map(self.by_chunk.__getitem__, tf.word_chunks(part)))
            elif (cut := tf.byte_chunks(part)) is not None:
                total += self.by_chunk[cut[0]] + sum(map(self.after_space.__getitem__, cut[1]))
            else:
                total += sum(map(self.by_piece.__getitem__, self.pieces.findall(part)))
        return total


@lru_cache(maxsize=4)
def merger(raw: bytes) -> PairMerger:
    """The merge table of a tokenizer file, built once in each Python worker."""
    return PairMerger(raw)


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every whole text; one row for each input row.

    Returns the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``
    (``n_tokens > limit``). A null text counts as empty: 0, 0, false. Special
    tokens inside a text count as one, as the library's default has it. Null
    ids and repeated rows stay as they are; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_bytes(tokenizer))

    def work(batches):
        count = merger(sent.value).count
        for batch in batches:
            n = [count(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    n_bytes = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes")
    out = map_texts(docs, [F.col(id_col).alias("id"), n_bytes, F.col(text_col).alias("text")], work, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
