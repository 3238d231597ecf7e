"""XXH64 of many byte ranges of one buffer at once, in NumPy."""

from __future__ import annotations

import numpy as np

# fixed values of the published hash function
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_U = np.uint64


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def hash_ranges(buffer: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of ``buffer[s : s + n]`` for each start and length, overlapping ones too.

    Works through ranges from long to short, so that each step touches only
    those that still have bytes for it.
    """
    count = len(starts)
    if not count:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(buffer + b"\0" * 8, np.uint8)
    # the eight bytes from each place on, little-endian
    words = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))

    def eight(at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(words[at]).view("<u8").ravel()

    order = np.argsort(-lengths, kind="stable")
    at, n = starts[order].astype(np.int64), lengths[order].astype(np.int64)
    left = n.copy()
    seed64 = _U(seed)
    with np.errstate(over="ignore"):
        h = np.full(count, seed64 + P5)
        long = int(np.searchsorted(-n, -32, side="right"))
        if long:
            v = [np.full(long, x) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            k = long
            while k:
                for i in range(4):
                    v[i][:k] = _round(v[i][:k], eight(at[:k] + 8 * i))
                at[:k] += 32
                left[:k] -= 32
                k = int(np.searchsorted(-left[:k], -32, side="right"))
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                acc = (acc ^ _round(np.zeros_like(x), x)) * P1 + P4
            h[:long] = acc
        h += n.astype(np.uint64)
        for _ in range(3):
            k = np.flatnonzero(left >= 8)
            if not len(k):
                break
            h[k] = _rotl(h[k] ^ _round(np.zeros(len(k), np.uint64), eight(at[k])), 27) * P1 + P4
            at[k] += 8
            left[k] -= 8
        k = np.flatnonzero(left >= 4)
        if len(k):
            h[k] = _rotl(h[k] ^ ((eight(at[k]) & _U(0xFFFFFFFF)) * P1), 23) * P2 + P3
            at[k] += 4
            left[k] -= 4
        for _ in range(3):
            k = np.flatnonzero(left > 0)
            if not len(k):
                break
            h[k] = _rotl(h[k] ^ (raw[at[k]].astype(np.uint64) * P5), 11) * P1
            at[k] += 1
            left[k] -= 1
        h ^= h >> _U(33)
        h *= P2
        h ^= h >> _U(29)
        h *= P3
        h ^= h >> _U(32)
    out = np.empty(count, np.uint64)
    out[order] = h
    return out
