"""Word shingles of whole texts as hashes."""

from __future__ import annotations

import numpy as np

from tessella.llm import xx64

_SPACE = 0x20


def word_bytes(text: str | None) -> bytes:
    """The words of a text with A-Z lower-cased, joined by one space."""
    return b" ".join(text.encode().lower().split()) if text else b""


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included, in order.

    With fewer words the whole sequence is the only shingle; without words
    there is none.
    """
    joined = word_bytes(text)
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == _SPACE)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.append(gaps, len(joined))
    if len(starts) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return xx64.hash_ranges(joined, starts, ends - starts, seed)


def many_shingle_hashes(texts: list[str | None], words: int, seed: int = 42) -> list[np.ndarray]:
    """``shingle_hashes`` of several texts, hashed together."""
    parts, spans, lengths, counts, at = [], [], [], [], 0
    for text in texts:
        joined = word_bytes(text)
        n = 0
        if joined:
            gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == _SPACE)
            starts = np.concatenate([[0], gaps + 1])
            ends = np.append(gaps, len(joined))
            if len(starts) > words:
                starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
            else:
                starts, ends = starts[:1], ends[-1:]
            spans.append(starts + at)
            lengths.append(ends - starts)
            n = len(starts)
        parts.append(joined)
        counts.append(n)
        at += len(joined)
    if not spans:
        return [np.zeros(0, np.uint64) for _ in texts]
    hashed = xx64.hash_ranges(b"".join(parts), np.concatenate(spans), np.concatenate(lengths), seed)
    return np.split(hashed, np.cumsum(counts)[:-1])


def fingerprint(hashes: np.ndarray) -> int:
    """A 64-bit SimHash: bit i is 1 if it is set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])
