"""Whole texts as byte arrays inside Arrow batches.

A ``mapInArrow`` task sees the UTF-8 bytes of many texts as one buffer.
The helpers here cut a batch into slices of bounded size, find words and
lines of a slice with vectorised masks and hash any byte range in constant
time from prefix sums, so that no Python object is made per word.

Hashes are 64-bit polynomial hashes over a random byte table, finalised by
a multiply-xorshift mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20

_U = np.uint64
_RNG = np.random.default_rng(20240611)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


@dataclass
class Texts:
    """A slice of a text column: ``data`` bytes; text i is data[starts[i]:ends[i]]."""
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: range          # positions in the batch

    def raw(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def __len__(self) -> int:
        return len(self.starts)


def text_slices(batch: pa.RecordBatch, name: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Slices of a batch's text column, of at most ``limit`` bytes or one
    text; a null text is an empty one."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(offs, kind)[col.offset:col.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        a, b = off[lo], off[hi]
        yield Texts(whole[a:b], off[lo:hi] - a, off[lo + 1:hi + 1] - a, range(lo, hi))
        lo = hi


def give_back() -> None:
    """Freed memory back to the system: Arrow's pool and the C library keep
    it otherwise, and Spark keeps a Python worker after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:                # glibc
        trim(0)


def lean(run):
    """``run``, a function of a task's batches, which gives back what it has
    freed when the task ends."""
    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_POWERS_STEP = 1 << 18
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = -(-n // _POWERS_STEP) * _POWERS_STEP      # kept by the worker: not twice what is needed
        one = np.full(size, _BASE, np.uint64)
        one[0] = 1
        _POWERS = np.multiply.accumulate(one)
        one = np.full(size, _INVERSE, np.uint64)
        one[0] = 1
        _INVERSES = np.multiply.accumulate(one)
    return _POWERS[:n], _INVERSES[:n]


class RangeHash:
    """Hash of any byte range of ``data`` from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self._inverse = _powers(n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * power[:n], out=self._sum[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._sum[ends] - self._sum[starts]) * self._inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64))

    def rolling(self, k: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Unmixed hash of every range of ``k`` bytes, by start (``lo`` to ``hi``)."""
        n = len(self._sum) - k if hi is None else min(hi, len(self._sum) - k)
        if n <= lo:
            return np.zeros(0, np.uint64)
        return (self._sum[lo + k:n + k] - self._sum[lo:n]) * self._inverse[lo:n]


def runs(t: Texts, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes (a 256-entry mask) that stay within one
    text: starts, ends and the number of runs of each text."""
    data = t.data
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(t), np.int64)
    m = member[data]
    begin = m.copy()
    begin[1:] &= ~m[:-1]
    edges = t.starts[t.ends > t.starts]
    begin[edges] = m[edges]
    end = m.copy()
    end[:-1] &= ~m[1:]
    last = t.ends[t.ends > t.starts] - 1
    end[last] = m[last]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    counts = np.searchsorted(starts, t.ends) - np.searchsorted(starts, t.starts)
    return starts, ends, counts


def mask(pred) -> np.ndarray:
    return np.array([bool(pred(b)) for b in range(256)])


#: ASCII white space: space and tab to carriage return.
SPACE = mask(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes (order matters)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + h[j:j + n]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark LONG."""
    return h.view(np.int64)
