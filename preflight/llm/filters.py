"""Bounded membership filters over 64-bit hashes.

``TwiceSeen`` is a pair of Bloom filters, once-seen and twice-seen: each task
sends the filter places of its hashes, ``PIECE`` hashes at a time, once per
place and marked if the piece has the hash twice; per filter chunk the places
of all pieces are merged, and a place that is set again moves on to the
twice-seen filter.  A hash met twice is in it for certain.

``bitmap`` makes a filter of a fixed number of bits from a column of
hashes.  Its size is a parameter, whatever the number of hashes, so it may
be sent to every task; beyond its capacity more strangers pass, and every
use of it is followed by an exact join or count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap(df: DataFrame, column: Column, bits_log2: int = 24) -> np.ndarray:
    """Bits ``hash mod 2^bits_log2`` of a LONG column, as 64-bit words.  At
    most 2^(bits_log2 - 6) aggregated rows come to the driver (4 MB for
    the default)."""
    place = column.bitwiseAND(F.lit((1 << bits_log2) - 1).cast("long"))
    words = (df.select(F.shiftright(place, 6).cast("int").alias("word"),
                       F.expr("shiftleft(1L, 0)").alias("one"),
                       place.bitwiseAND(F.lit(63).cast("long")).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")))
    got = words.toArrow()
    out = np.zeros(1 << max(bits_log2 - 6, 0), np.uint64)
    if got.num_rows:
        at = got["word"].to_numpy()
        keep = ~np.isnan(at) if at.dtype.kind == "f" else slice(None)
        out[at[keep].astype(np.int64)] = got["bits"].to_numpy()[keep].astype(np.int64).view(np.uint64)
    return out


def contains(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes may be members."""
    place = h & np.uint64(len(words) * 64 - 1)
    return (words[(place >> np.uint64(6)).astype(np.int64)]
            >> (place & np.uint64(63))) & np.uint64(1) != 0


CHUNK_LOG2 = 16
PIECE = 1 << 20         # hashes that a task holds at once (or one array of them)
PLACES = "chunk int, once binary, twice binary"


def places(h: np.ndarray, bits_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """The two filter places of each hash."""
    low = h & np.uint64((1 << bits_log2) - 1)
    high = (h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - bits_log2)
    return low, high


def places_of_task(hashes, bits_log2: int):
    """Batches ``PLACES`` of a task's hash arrays (a hash counts once in an
    array), one for each ``PIECE`` hashes: what a task holds does not grow
    with what it reads."""
    held, n = [], 0
    for h in hashes:
        if held and n + len(h) > PIECE:
            yield _places_of_piece(held, bits_log2)
            held, n = [], 0
        held.append(h)
        n += len(h)
    if n:
        yield _places_of_piece(held, bits_log2)


def _places_of_piece(held: list[np.ndarray], bits_log2: int) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate(held), return_counts=True)
    once = np.unique(np.concatenate(places(h, bits_log2)))
    twice = np.unique(np.concatenate(places(h[n > 1], bits_log2)))
    inner, shift = np.uint64((1 << CHUNK_LOG2) - 1), np.uint64(CHUNK_LOG2)
    cuts = np.flatnonzero(np.diff(once >> shift)) + 1
    rows = {"chunk": [], "once": [], "twice": []}
    for part in np.split(once, cuts) if len(once) else []:
        c = part[0] >> shift
        lo, hi = np.searchsorted(twice, np.array([c << shift, (c + np.uint64(1)) << shift], np.uint64))
        rows["chunk"].append(int(c))
        rows["once"].append((part & inner).astype(np.uint16).tobytes())
        rows["twice"].append((twice[lo:hi] & inner).astype(np.uint16).tobytes())
    return pa.RecordBatch.from_pydict(rows, schema=pa.schema(
        [("chunk", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))


def _merge(table: pa.Table) -> pa.Table:
    """The places of a chunk, of all tasks and pieces: the twice-seen bits."""
    once, twice = np.zeros(1 << CHUNK_LOG2, bool), np.zeros(1 << CHUNK_LOG2, bool)
    for a, b in zip(table["once"], table["twice"]):
        at = np.frombuffer(a.as_py(), np.uint16)
        twice[at[once[at]]] = True
        once[at] = True
        twice[np.frombuffer(b.as_py(), np.uint16)] = True
    return pa.table({"chunk": table["chunk"][:1],
                     "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})


class TwiceSeen:
    """The twice-seen filter of ``n`` hashes: 8 bits a hash, up to 2^max_bits
    bits in all (its bound; beyond it more strangers pass)."""

    def __init__(self, n: int, max_bits: int):
        self.bits = min(max(CHUNK_LOG2, (8 * max(n, 1) - 1).bit_length()), max_bits)
        self.words = None

    def fill(self, sent: DataFrame) -> "TwiceSeen":
        """``sent``: rows ``PLACES`` of all tasks and pieces."""
        got = sent.groupBy("chunk").applyInArrow(_merge, "chunk int, bits binary").toArrow()
        out = np.zeros((1 << (self.bits - CHUNK_LOG2), (1 << CHUNK_LOG2) // 8), np.uint8)
        for c, b in zip(got["chunk"].to_pylist(), got["bits"].to_pylist()):
            out[c] = np.frombuffer(b, np.uint8)
        self.words = out.reshape(-1)
        return self

    def has(self, h: np.ndarray) -> np.ndarray:
        """Which hashes may have been met twice."""
        ok = np.ones(len(h), bool)
        for place in places(h, self.bits):
            at = place.astype(np.int64)
            ok &= (self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0
        return ok
