"""An adaptive context-mixing range coder for 16-bit token ids, over many blocks in step.

Every block is coded from a fresh model and has its own checksum, so any block
can be read alone. The model of a block mixes three predictions of the next id:

* order 2: the id that last followed the same two ids (hashed),
* order 1: the id that last followed the same id (hashed),
* order 0: adaptive frequencies of the high byte times those of the low byte.

An id's probability is the weighted sum of what all three give it. The weights
belong to a context: how often orders 2 and 1 were right in a row, and whether
they agree. After each id a weight moves towards the share of the probability
that its order contributed (the step of expectation maximisation for mixtures).
The sum is coded in one arithmetic step: the ids that orders 2 and 1 name come
first, each with all its mass, then all others by order 0, those two left out.

Blocks are independent, so all blocks of a frame advance together, one id a
step, as NumPy vectors: the interpreter's cost is shared by all of them. All
arithmetic that the decoder has to repeat is in integers, but for one quotient
in the weights, which IEEE rules fix to the last bit. ``FrameCoder.java`` has
the same loops for Spark's tasks and gives the same bytes, so a change here is
a change there.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids in a block.
BLOCK = 2048
_SLOTS = 1024
# all weights add up to 2**12; order 0 has 2**11 parts for the high byte and 2**10 for the low one
_WEIGHT, _HIGH, _LOW = 12, 11, 10
_ZERO = _HIGH + _LOW
_TOTAL = np.uint64(_WEIGHT + _ZERO)
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 40)
_W, _OUT = np.uint64(16), np.uint64(48)
#: What orders 2 and 1 can get together, of 4096.
_SHARE = 4032
_SURE = 4  # 0: nothing seen yet; 1 to 3: right so often in a row
_CONTEXTS = _SURE * _SURE * 2
_RATE = 5
_LAST = np.uint64((1 << _ZERO) - 1)
_PART = 0xFFF
_BYTES = np.arange(256, dtype=np.uint8)
# fixed values: where the weights start, of 65536, by how often an order was right in a row
_START = (300, 9000, 30000, 52000)
_MIXING = np.array([[40503], [30011]], np.int64)


class _Model:
    """The models of all blocks, one column each. Row 0 of what ``predict`` gives is order 2, row 1 is order 1."""

    def __init__(self, lanes: int, search: bool):
        self.search = search
        self.counts = np.concatenate([np.tile(np.maximum(1, 256 // (1 + np.arange(256, dtype=np.int32))), lanes), np.ones(lanes * 256, np.int32)])
        start = np.array([[(_START[a], (65536 - _START[a]) * _START[b] >> 16)] * 2 for a in range(_SURE) for b in range(_SURE)], np.int32).reshape(-1, 2)
        self.trust = np.concatenate([np.tile(start[:, 0], lanes), np.tile(start[:, 1], lanes)])
        self.seen = np.zeros(2 * lanes * _SLOTS, np.int32)
        self.x = np.zeros((2, lanes), np.int64)
        self.lanes = lanes
        self.narrow(lanes)
        self.refresh()

    def narrow(self, k: int) -> None:
        """Go on with the first ``k`` blocks alone."""
        at, both = np.arange(k, dtype=np.int64), np.arange(2, dtype=np.int64)[:, None] * self.lanes
        self.high_at, self.low_at = at * 256, (at + self.lanes) * 256
        self.high_names_at, self.low_names_at = at << _HIGH, at << _LOW
        self.slots, self.contexts = (at + both) * _SLOTS, (at + both) * _CONTEXTS
        self.x = np.ascontiguousarray(self.x[:, :k])

    @staticmethod
    def _packed(counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each byte's part starts and how long it is, in one number; and the lengths. Every byte has a part."""
        sums = np.cumsum(counts.reshape(-1, 256), axis=1, dtype=np.int32)
        free = (1 << bits) - 256
        ends = (sums * (free / sums[:, -1:])).astype(np.int32)
        ends[:, -1] = free
        ends += np.arange(1, 257, dtype=np.int32)
        length = np.diff(ends, axis=1, prepend=np.int32(0))
        return ((ends - length) << 12 | length).reshape(-1), length.reshape(-1)

    def refresh(self) -> None:
        half = self.lanes * 256
        (high, long), (low, short) = self._packed(self.counts[:half], _HIGH), self._packed(self.counts[half:], _LOW)
        self.parts = np.concatenate([high, low])
        if self.search:
            names = np.tile(_BYTES, self.lanes)
            self.high_names, self.low_names = np.repeat(names, long), np.repeat(names, short)

    def zero(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ids start in order 0, and their mass there."""
        high, low = self.parts.take(self.high_at + (ids >> 8)).astype(np.int64), self.parts.take(self.low_at + (ids & 255))
        length = high & _PART
        return (high >> 12 << _LOW) + length * (low >> 12), length * (low & _PART)

    def find(self, place: np.ndarray) -> np.ndarray:
        """The ids that hold places in order 0."""
        name = self.high_names.take(self.high_names_at + (place >> _LOW)).astype(np.int64)
        high = self.parts.take(self.high_at + name).astype(np.int64)
        rest = (place - (high >> 12 << _LOW)).view(np.uint64) // (high & _PART).view(np.uint64)
        return self.low_names.take(self.low_names_at + rest.view(np.int64)) + (name << 8)

    def predict(self) -> None:
        x = self.x * _MIXING
        x[0] += x[1]
        x[1] = x[0] - x[1]
        self.slot = self.slots + ((x >> 5) & (_SLOTS - 1))
        seen = self.seen.take(self.slot).astype(np.int64)
        a = self.a = seen & 0xFFFF
        self.sure = seen >> 16
        same = a[0] == a[1]
        self.context = self.contexts + (((self.sure[0] << 2) + self.sure[1] << 1) + same)
        self.held = self.trust.take(self.context)
        w = (self.held * _SHARE >> 16).astype(np.int64)
        self.w0 = (1 << _WEIGHT) - w[0] - w[1]
        w <<= _ZERO
        self.w = w
        start, mass = self.zero(a)
        self.start = start * self.w0
        mass *= self.w0
        self.mass = mass
        # all mass of the id of order 2, and of both ids
        mass[1] *= ~same
        self.second = w[0] + mass[0] + w[1] * same
        self.named = w[0] + w[1] + mass[0] + mass[1]

    def learn(self, x: np.ndarray, hit: np.ndarray, freq: np.ndarray) -> None:
        gained = (self.w * hit * (65535.0 / freq)).astype(np.int32)
        self.trust[self.context] = self.held + (gained - self.held >> _RATE)
        self.seen[self.slot] = ((np.minimum(self.sure, _SURE - 2) * hit + 1) << 16) + x
        missed = np.flatnonzero(~(hit[0] | hit[1]))
        y = x[missed]
        self.counts[self.high_at[missed] + (y >> 8)] += 24
        self.counts[self.low_at[missed] + (y & 255)] += 8
        self.x[1] = self.x[0]
        self.x[0] = x


def _refreshes(step: int) -> bool:
    return step in (8, 16, 32, 64, 128) or step % 256 == 0 and step > 0


def _order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks from long to short, and how many of them still have an id at each step."""
    order = np.argsort(-lengths, kind="stable")
    steps = np.arange(int(lengths.max(initial=0)))
    return order, np.searchsorted(-lengths[order], -steps, side="left")


def _interval(m: _Model, x: np.ndarray, second: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the interval of ids ``x`` starts, and its length; ``second`` and ``first`` say whom orders 2 and 1 name."""
    start, freq = m.zero(x)
    gone = m.mass * (m.a < x)
    start = start * m.w0 + (m.named - gone[0] - gone[1])
    start = np.where(second, 0, np.where(first, m.second, start))
    return start, np.where(second, m.second, np.where(first, m.named - m.second, freq * m.w0))


def _shifts(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Blocks whose next 16 bits are settled, or whose range is too short to go on with."""
    return np.flatnonzero(((low ^ (low + size)) < _TOP) | (size < _BOT))


def _shift(low: np.ndarray, size: np.ndarray, todo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Move 16 bits out of the blocks ``todo``; the bits, and which of them are still to be shifted."""
    lo, r = low[todo], size[todo]
    r = np.where((lo ^ (lo + r)) < _TOP, r, (~lo + np.uint64(1)) & (_BOT - np.uint64(1)))
    bits = lo >> _OUT
    lo, r = lo << _W, r << _W
    low[todo], size[todo] = lo, r
    return bits, todo[_shifts(lo, r)]


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[list[bytes], np.ndarray]:
    """Code ids below 65536 in blocks; the coded bytes and the CRC-32 of each block's ids."""
    ids = np.ascontiguousarray(ids, "<u2")
    n = len(ids)
    lanes = -(-n // block)
    lengths = np.minimum(block, n - np.arange(lanes) * block)
    checks = np.array([zlib.crc32(ids[i * block : (i + 1) * block]) for i in range(lanes)], np.uint32)
    if not lanes:
        return [], checks
    table = np.zeros((lanes, block), np.uint16)
    table.reshape(-1)[:n] = ids
    order, active = _order(lengths)
    table = np.ascontiguousarray(table[order].T)
    m = _Model(lanes, search=False)
    lows, sizes = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    low, size = lows, sizes
    out = np.zeros((lanes, 2 * block + 64), np.uint16)
    at = np.zeros(lanes, np.int64)
    for t, k in enumerate(active.tolist()):
        if _refreshes(t):
            m.refresh()
        if t % 128 == 0 and at.max() + 1024 > out.shape[1]:
            out = np.pad(out, ((0, 0), (0, block + 1024)))
        if k < m.x.shape[1]:
            m.narrow(k)
            low, size = lows[:k], sizes[:k]
        x = table[t, :k].astype(np.int64)
        m.predict()
        hit = m.a == x
        start, freq = _interval(m, x, hit[0], hit[1])
        r = size >> _TOTAL
        low += start.view(np.uint64) * r
        np.multiply(freq.view(np.uint64), r, out=size)
        todo = _shifts(low, size)
        while len(todo):
            where = todo
            bits, todo = _shift(low, size, todo)
            out[where, at[where]] = bits
            at[where] += 1
        m.learn(x, hit, freq)
    # 32 bits that lie in the last range, whatever follows them
    lows += np.uint64(0xFFFFFFFF)
    rows = np.arange(lanes)
    out = np.pad(out, ((0, 0), (0, 2)))
    for shift in (48, 32):
        out[rows, at] = lows >> np.uint64(shift)
        at += 1
    coded: list[bytes] = [b""] * lanes
    for row, i in enumerate(order.tolist()):
        coded[i] = out[row, : at[row]].astype("<u2").tobytes()
    return coded, checks


def decode_blocks(coded: list[bytes], lengths: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The ids of some blocks, joined; raises ValueError if a checksum doesn't hold."""
    lengths = np.asarray(lengths, np.int64)
    lanes = len(coded)
    if not lanes:
        return np.zeros(0, "<u2")
    order, active = _order(lengths)
    words = np.zeros((lanes, max(map(len, coded)) // 2 + 6), np.uint64)
    for row, i in enumerate(order.tolist()):
        got = np.frombuffer(coded[i], "<u2")
        words[row, : len(got)] = got
    table = np.zeros((len(active), lanes), np.uint16)
    m = _Model(lanes, search=True)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    code = (words[:, 0] << np.uint64(48)) | (words[:, 1] << np.uint64(32)) | (words[:, 2] << _W) | words[:, 3]
    at = np.full(lanes, 4, np.int64)
    for t, k in enumerate(active.tolist()):
        if _refreshes(t):
            m.refresh()
        if k < m.x.shape[1]:
            m.narrow(k)
            low, size, code = low[:k], size[:k], code[:k]
        m.predict()
        r = size >> _TOTAL
        v = ((code - low) // r).view(np.int64)
        second, named = v < m.second, v < m.named
        # a place in order 0, first without the two ids, then with them
        u = np.maximum(v - m.named, 0)
        swap = m.start[0] > m.start[1]
        u += np.where(swap, m.mass[1], m.mass[0]) * (u >= np.minimum(m.start[0], m.start[1]))
        u += np.where(swap, m.mass[0], m.mass[1]) * (u >= np.maximum(m.start[0], m.start[1]))
        x = m.find(np.minimum(u.view(np.uint64) // m.w0.view(np.uint64), _LAST).view(np.int64))
        x = np.where(second, m.a[0], np.where(named, m.a[1], x))
        start, freq = _interval(m, x, second, named)
        low += start.view(np.uint64) * r
        size = freq.view(np.uint64) * r
        todo = _shifts(low, size)
        while len(todo):
            where = todo
            _, todo = _shift(low, size, todo)
            code[where] = (code[where] << _W) | words[where, np.minimum(at[where], words.shape[1] - 1)]
            at[where] += 1
        m.learn(x, m.a == x, freq)
        table[t, :k] = x
    columns = np.ascontiguousarray(table.T)
    parts: list[np.ndarray] = [np.zeros(0, "<u2")] * lanes
    for row, i in enumerate(order.tolist()):
        parts[i] = columns[row, : lengths[i]].astype("<u2")
        if zlib.crc32(parts[i]) != int(checks[i]):
            raise ValueError(f"block {i}: checksum does not hold")
    return np.concatenate(parts)
