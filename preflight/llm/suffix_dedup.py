"""Operator 1 — repeated byte strings, by suffix arrays and LPF.

A string of ``length`` (400) bytes is repeated if it starts anywhere else in
the corpus, in its own text included; matches never cross texts.

Partition.  Every string of 400 bytes holds, among its k-grams (k = 256), a
minimum hash that depends on the string alone; all places of that minimum
are its anchors.  Equal strings share the anchor's k-gram (*core*) and lie
alike around it, so all copies of a string meet under the hash of a core.
An anchor's *context* is what its strings can reach: 144 bytes on either
side of the core, cut at the text's ends.

1. One pass hashes cores and contexts; a count (first within each task) finds
   the classes of equal contexts.  A class of two or more is repeated as a
   whole; no text moves.
2. Where one core has different contexts, one context of each class is
   sent, by core.  A task joins the contexts of many cores (in order of
   their first place in the corpus), builds the suffix array to the depth of
   a string without its core by prefix doubling (sorted values hold their
   place), and the LPF array: for every suffix the previous and next smaller
   position in suffix order and the common prefix with these, as far as it
   reaches 400 bytes (shorter ones count as none).  Where LPF is 400 there is an earlier copy; the LPF array of
   mirrored positions finds later ones.  Repeated strings come back as ranges.
3. A core with over ``max_contexts`` contexts is no task's work: its contexts
   are sent one by one, their strings cut into pieces of 8 starts, pieces are
   counted by hash as in 1, and only the starts of pieces that share their own
   core are counted one by one.  Adjoining ranges are joined before they move.
4. The ranges join the anchors of a third pass; each text loses their union.
   Texts that lose nothing are not shuffled.

``keep="none"`` removes every copy, ``keep="first"`` all but the first (by
doc_id, nulls first, then text hash and place).

Cases: null and empty texts have no bytes; texts under 400 bytes lose
nothing; equal rows are copies of each other; rows of one doc_id are texts
of their own; a cut may leave half a character, so the remaining bytes are
handed out as binary.  A text of any length is one text; an empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from preflight.llm.arrow_text import RangeHash, Texts, mix, signed, text_slices
from preflight.llm.filters import bitmap, contains
from preflight.llm.joins import row_hash, salted_join
from preflight.llm.ship import ship
from preflight.session import materialize

LENGTH, CORE = 400, 256
MAX_CONTEXTS = 4096
PIECE = 8
HOT_SALTS = 4
BATCH_BYTES = 1 << 16
BLOCK = 1 << 15
FILTER_BITS = 26        # 8 MB
_U = np.uint64


# ── anchors ────────────────────────────────────────────────────────────────

def sliding_min(x: np.ndarray, w: int, least=np.minimum) -> np.ndarray:
    """Minimum (``np.maximum``: maximum) of every ``w`` consecutive values, by
    windows of twice the width."""
    have = 1
    while 2 * have <= w:
        x = least(x[:-have], x[have:])
        have *= 2
    return least(x[:len(x) - (w - have)], x[w - have:]) if have < w else x


class Anchors:
    """Anchors of a slice: ``text`` (index), ``at`` (core's start), ``lo`` and
    ``hi`` (context), ``core`` and ``ctx`` (hashes).  Their places are looked
    for block by block, so that the arrays stay in the processor's cache."""

    def __init__(self, t: Texts, length: int, k: int):
        self.hash = RangeHash(t.data)
        w = length - k + 1
        size = t.ends - t.starts
        whole = np.maximum(size - length + 1, 0)      # starts of strings that end in their text
        outside = np.repeat(np.arange(2 * len(t)) % 2 > 0, np.stack([whole, size - whole], 1).reshape(-1))
        n, none = len(t.data) - k + 1, np.zeros(w - 1, np.uint64)
        at, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lo in range(0, n, BLOCK) if n >= w else ():
            hi = min(lo + BLOCK, n)
            a, b = max(lo - w + 1, 0), min(hi + w - 1, n)       # every string that reaches into the block
            gram = self.hash.rolling(k, a, b)
            least = sliding_min(gram, w)
            least[outside[a:a + len(least)]] = 0
            most = sliding_min(np.concatenate([none, least, none]), w, np.maximum)
            found = np.flatnonzero(most[lo - a:hi - a] == gram[lo - a:hi - a]) + (lo - a)
            at.append(found + a)
            grams.append(gram[found])
        self.at = np.concatenate(at)
        self.core = mix(np.concatenate(grams))
        self.text = np.searchsorted(t.ends, self.at, side="right")
        self.lo = np.maximum(self.at - (length - k), t.starts[self.text])
        self.hi = np.minimum(self.at + length, t.ends[self.text])
        self.ctx = mix(self.hash(self.lo, self.hi) + (self.at - self.lo).astype(np.uint64))

    def place(self, t: Texts, row: np.ndarray) -> np.ndarray:
        """Hash of each anchor's place in the corpus, as many bits as a filter has."""
        return mix(row[self.text].view(np.uint64) + _U(0x632BE59BD9B4E019)
                   * (self.at - t.starts[self.text] + 1).astype(np.uint64)) & _U((1 << FILTER_BITS) - 1)


def _column(b, name):
    return b.column(b.schema.get_field_index(name))


def _hashed(length: int, k: int, ordered: bool):
    """Pass 1: classes of equal contexts, counted within the task, with their
    least place; ``ordered``: every anchor with the parts of its place."""
    def run(batches):
        found = []
        for b in batches:
            rows = _column(b, "row").to_numpy()
            ids = _column(b, "doc_id").cast(pa.int64())
            for t in text_slices(b):
                a = Anchors(t, length, k)
                place = a.place(t, rows[t.rows.start:t.rows.stop])
                if not ordered:
                    found.append((a.core, a.ctx, place))
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(a.core)), pa.array(signed(a.ctx)), pa.array(np.ones(len(a.at), np.int64)),
                     pa.array(signed(place)), ids.take(pa.array(a.text + t.rows.start)),
                     pa.array(rows[a.text + t.rows.start]), pa.array((a.at - t.starts[a.text]).astype(np.int32))],
                    names=[*NAMES, "doc_id", "row", "at"])
        if not ordered:
            core, ctx, place = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64)
                                for i in range(3))
            order = np.lexsort((place, ctx, core))
            core, ctx, place = core[order], ctx[order], place[order]
            first = np.ones(len(core), bool)
            first[1:] = (core[1:] != core[:-1]) | (ctx[1:] != ctx[:-1])
            at = np.flatnonzero(first)
            n = np.diff(np.r_[at, len(core)])
            for lo in range(0, len(at), 50_000):
                i = at[lo:lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(core[i])), pa.array(signed(ctx[i])), pa.array(n[lo:lo + 50_000]),
                     pa.array(signed(place[i]))], names=NAMES)
    return run


NAMES = ["core", "ctx", "n", "place"]
CLASS = "core long, ctx long, n long, place long"
WHERE = ", doc_id long, row long, at int"


# ── suffix arrays ──────────────────────────────────────────────────────────

def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of keys of so many bits, and the keys in it.  Sorting
    values is several times as fast as sorting places, so a place goes into
    the low bits of its key where both fit in 64."""
    low = len(key).bit_length()
    if bits + low > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    s = (key << _U(low)) | np.arange(len(key), dtype=np.uint64)
    s.sort()
    return (s & _U((1 << low) - 1)).view(np.int64), s >> _U(low)


def _ranks(key: np.ndarray, bits: int) -> np.ndarray:
    order, s = _sorted(key, bits)
    step = np.zeros(len(s), np.uint64)
    step[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), np.uint64)
    out[order] = np.cumsum(step)
    return out


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` bytes; equal ranks mean
    equal bytes.  Prefix doubling from keys of as many bytes as fit beside a
    place (a byte is its number among those in use); past the end is zero."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64)
    used = np.bincount(data, minlength=256) > 0
    wide, low = int(used.sum()).bit_length(), n.bit_length()
    h = min(max((64 - low) // wide, 1), depth)
    more = np.zeros(n + h, np.uint64)
    more[:n] = np.cumsum(used).astype(np.uint64)[data]
    key = np.zeros(n, np.uint64)
    for j in range(h):
        key = (key << _U(wide)) | more[j:j + n]
    rank = _ranks(key, wide * h)
    while h < depth:
        step = min(h, depth - h)
        key = rank << _U(low)
        key[:n - step] |= rank[step:] + _U(1)
        rank = _ranks(key, 2 * low)
        h += step
    return rank


def _nearest_smaller(place: np.ndarray, lcp: np.ndarray, todo: np.ndarray, floor: int) -> np.ndarray:
    """Suffixes in suffix order: of those in ``todo``, the common prefix with
    the nearest one before that starts at a smaller place; 0 if there is none
    or it is under ``floor``.

    Pointers jump: between a suffix and its pointer no place is smaller, so a
    pointer that does not fit is replaced by its own pointer, and the least
    common prefix on the way is carried along."""
    to, least = np.arange(-1, len(place) - 1), lcp.copy()
    out = np.zeros(len(place), lcp.dtype)
    while len(todo):
        todo = todo[(to[todo] >= 0) & (least[todo] >= floor)]
        at = to[todo]
        hit = place[at] < place[todo]
        out[todo[hit]] = least[todo[hit]]
        todo, at = todo[~hit], at[~hit]
        least[todo] = np.minimum(least[todo], least[at])
        to[todo] = to[at]
    return out


def lpf(place: np.ndarray, lcp: np.ndarray, floor: int = 1, cap: int | None = None,
        todo: np.ndarray | None = None) -> np.ndarray:
    """Longest previous factor of every suffix, in suffix order: the longest
    prefix that also starts at a smaller place.  ``lcp``: common prefix with
    the suffix before (the first: 0), known up to ``cap``.  It is found at the
    nearest smaller place before or after in suffix order; where the one
    before reaches ``cap`` the other is not looked for.  Values under ``floor``
    are 0, as are those of suffixes that are not in ``todo`` (all)."""
    n = len(place)
    todo = np.arange(n) if todo is None else todo
    before = _nearest_smaller(place, lcp, todo, floor)
    todo = todo if cap is None else todo[before[todo] < cap]
    after = _nearest_smaller(place[::-1], _turned(lcp), n - 1 - todo, floor)[::-1]
    return np.maximum(before, after)


def _turned(lcp: np.ndarray) -> np.ndarray:
    """The same common prefixes for the suffixes in reverse order."""
    return np.concatenate([lcp[:1] * 0, lcp[:0:-1]])


def earlier_and_later(rank: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes at ``place`` in the corpus, ranked by ``depth`` bytes:
    which have a longest previous factor of ``depth``, and which of the others
    a longest following one.  A place may come up more than once (contexts
    overlap); it is no match of itself."""
    n = len(rank)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    order, s = _sorted(rank, int(rank.max()).bit_length())
    p = place[order]
    lcp = np.zeros(n, np.int32)
    lcp[1:] = np.where(s[1:] == s[:-1], depth, 0)         # under depth: not told apart from 0
    earlier, later = np.empty(n, bool), np.empty(n, bool)
    earlier[order] = lpf(p, lcp, depth, depth) >= depth
    first = n - 1 - np.flatnonzero(~earlier[order])
    later[order] = lpf(-p[::-1], _turned(lcp), depth, depth, first)[::-1] >= depth
    return earlier, later


def _ranges(flag: np.ndarray, owner: np.ndarray, o: np.ndarray):
    """Maximal runs of flagged consecutive offsets of one owner."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at, at
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner[at]) != 0))
    first, last = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]
    return owner[first], o[first], o[last]


RANGES = "core long, ctx long, far int, near int"


def _factors(reach: int, ordered: bool):
    """Contexts sorted by core, many cores at once: ranges of offsets (bytes
    from a string's start to its core) whose string is repeated elsewhere
    (``ordered``: earlier).

    All strings of a context hold its core, so the suffix array is built over
    the contexts without it: what is left of a string are ``reach`` bytes.
    Two strings are equal if these are, and core and offset too."""
    def solve(rows):
        rows.sort(key=lambda r: r[2])                 # first place in the corpus
        seen, texts, cores, data, core, ctx, left, place = set(), {}, {}, [], [], [], [], []
        for c, x, at, n, raw in rows:
            if (c, x) not in seen:
                seen.add((c, x))
                place.append((texts.setdefault(at[:3], len(texts)) << 36) + at[3] - n)
                data.append(raw)
                core.append(c)
                ctx.append(x)
                left.append(n)
        group = np.array([cores.setdefault(c, len(cores)) for c in core], np.uint64)
        size = np.array([len(x) for x in data])
        core, ctx, left = np.array(core, np.int64), np.array(ctx, np.int64), np.array(left)
        whole = np.frombuffer(b"".join(data), np.uint8)
        starts = np.cumsum(size) - size
        n_win = np.maximum(size - reach + 1, 0)
        owner = np.repeat(np.arange(len(size)), n_win)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
        o = left[owner] - inner                       # falls from far to near
        rank = suffix_ranks(whole, reach)[starts[owner] + inner] * _U(len(cores) * (reach + 1))
        rank += group[owner] * _U(reach + 1) + o.astype(np.uint64)
        earlier, later = earlier_and_later(rank, np.array(place, np.int64)[owner] + inner, reach)
        own, far, near = _ranges(earlier if ordered else earlier | later, owner, o)
        return pa.RecordBatch.from_arrays(
            [pa.array(core[own]), pa.array(ctx[own]), pa.array(far.astype(np.int32)), pa.array(near.astype(np.int32))],
            names=["core", "ctx", "far", "near"])

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            cores, ctxs = _column(b, "core").to_pylist(), _column(b, "ctx").to_pylist()
            keys = zip(*[_column(b, c).to_pylist() for c in ("doc_id", "row", "at")])
            for c, x, k, n, raw in zip(cores, ctxs, keys, _column(b, "left").to_pylist(), _column(b, "raw").to_pylist()):
                if size >= BATCH_BYTES and c != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append((c, x, (k[0] is not None, k[0] or 0, k[1], k[2]), n, raw))
                size += len(raw)
                last = c
        if rows:
            yield solve(rows)
    return run


def _contexts(length: int, k: int, shared):
    """Pass 2: the bytes of the contexts (without their core) whose core and
    place pass a bitmap each."""
    def run(batches):
        for b in batches:
            ids, hashes = _column(b, "doc_id").cast(pa.int64()), _column(b, "row").to_numpy()
            for t in text_slices(b):
                a = Anchors(t, length, k)
                cores, places = shared.value
                place = a.place(t, hashes[t.rows.start:t.rows.stop])
                at = np.flatnonzero(contains(cores, a.core) & contains(places, place))
                rows = a.text[at] + t.rows.start
                raw = [t.data[x:p].tobytes() + t.data[p + k:y].tobytes()
                       for x, p, y in zip(a.lo[at], a.at[at], a.hi[at])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(a.core[at])), pa.array(signed(a.ctx[at])), ids.take(pa.array(rows)),
                     pa.array(hashes[rows]), pa.array((a.at[at] - t.starts[a.text[at]]).astype(np.int32)),
                     pa.array((a.at - a.lo)[at].astype(np.int32)), pa.array(raw, pa.binary())],
                    names=["core", "ctx", "doc_id", "row", "at", "left", "raw"])
    return run


CONTEXTS = "core long, ctx long, doc_id long, row long, at int, left int, raw binary"
PIECES = "core long, ctx long, doc_id long, row long, at int, pcore long, pctx long, far int, near int"


def _pieces(reach: int, shared=None):
    """The pieces of contexts, ``far`` to ``near`` cut at the text's ends:
    hashes of what all strings of the whole piece share and of all its bytes.
    ``shared``: only pieces whose ``pcore`` passes a bitmap, with the hashes
    of their strings."""
    first = np.arange(0, reach + 1, PIECE)
    last = np.minimum(first + PIECE - 1, reach)

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
                raw = _column(b, "raw").to_pylist()
                size = np.array([len(x) for x in raw])
                left = _column(b, "left").to_numpy().astype(np.int64)
                hashed = RangeHash(np.frombuffer(b"".join(raw), np.uint8))
                mid = np.cumsum(size) - size + left            # where the core was
                near = np.maximum(first[None, :], (reach - size + left)[:, None])
                far = np.minimum(last[None, :], left[:, None])
                row, piece = np.nonzero(near <= far)
                lo, hi, p = far[row, piece], near[row, piece], mid[row]
                salt = mix(_column(b, "core").to_numpy().view(np.uint64)[row]) + piece.astype(np.uint64)
                pcore = mix(hashed(p - first[piece], p - last[piece] + reach) + salt)
                if shared is not None:
                    ok = contains(shared.value, pcore)
                    row, lo, hi, p, salt, pcore = (x[ok] for x in (row, lo, hi, p, salt, pcore))
                pctx = mix(hashed(p - lo, p - hi + reach) + _U(997) * lo.astype(np.uint64) + salt)
                take = pa.array(row)
                cols = [*(_column(b, c).take(take) for c in ("core", "ctx", "doc_id", "row", "at")),
                        pa.array(signed(pcore)), pa.array(signed(pctx)),
                        pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
                names = ["core", "ctx", "doc_id", "row", "at", "pcore", "pctx", "far", "near"]
                if shared is not None:
                    count = lo - hi + 1
                    off = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    o = np.repeat(hi, count) + np.arange(off[-1]) - np.repeat(off[:-1], count)
                    s = np.repeat(p, count) - o
                    core = np.repeat(_column(b, "core").to_numpy().view(np.uint64)[row], count)
                    strings = mix(hashed(s, s + reach) + mix(core) + _U(997) * o.astype(np.uint64))
                    cols.append(pa.ListArray.from_arrays(off, pa.array(signed(strings))))
                    names.append("strings")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def _hot_ranges(contexts: DataFrame, reach: int, ordered: bool) -> DataFrame:
    """``RANGES`` of the contexts of hot cores, by counting hashes of their
    pieces.  A string holds the core at one offset, so core and offset are
    part of every hash."""
    spark = contexts.sparkSession
    where = F.struct("doc_id", "row", "at")
    contexts = materialize(contexts.groupBy("core", "ctx").agg(F.min(F.struct("doc_id", "row", "at", "left", "raw"))
                           .alias("c")).select("core", "ctx", "c.*"), "contexts")
    pieces = contexts.mapInArrow(_pieces(reach), PIECES)
    count = [F.count(F.lit(1)).alias("n"), *([F.min(where).alias("first")] if ordered else [])]
    kinds = materialize(pieces.groupBy("pcore", "pctx").agg(*count), "kinds")
    own = salted_join(pieces, kinds.filter("n > 1"), ["pcore", "pctx"], F.col("ctx"), HOT_SALTS)
    # strings of pieces that share their core but not their context
    mixed = kinds.groupBy("pcore").agg(F.count(F.lit(1)).alias("d")).filter("d > 1").select("pcore")
    mixed = materialize(mixed, "mixed")
    known = spark.sparkContext.broadcast(bitmap(mixed, F.col("pcore"), FILTER_BITS))
    single = salted_join(contexts.mapInArrow(_pieces(reach, known), PIECES + ", strings array<long>"),
                         mixed, ["pcore"], F.col("ctx"), HOT_SALTS)
    single = (single.select("core", "ctx", "doc_id", "row", "at", "near", F.posexplode("strings").alias("i", "string"))
              .withColumn("o", F.col("near") + F.col("i")))
    # a string is at one place for several cores
    here = F.struct("doc_id", "row", (F.col("at") - F.col("o")).alias("at"))
    single = materialize(single, "strings")
    often = (single.groupBy("string").agg(F.min(here).alias("first"), F.max(here).alias("last"))
             .filter("first <> last").select("string", "first"))
    got = salted_join(single, often, ["string"], F.col("ctx"), HOT_SALTS)
    if ordered:
        own, got = own.filter(where != F.col("first")), got.filter(here != F.col("first"))
    return own.select("core", "ctx", "far", "near").union(
        got.select("core", "ctx", F.col("o").alias("far"), F.col("o").alias("near")))


def _joined(parts):
    """Adjoining ranges of offsets as one."""
    ranges = F.sort_array(parts)

    def add(done, x):
        last = F.element_at(done, -1)
        both = F.struct(last["near"].alias("near"), F.greatest(last["far"], x["far"]).alias("far"))
        return F.when(x["near"] <= last["far"] + 1, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))
                      ).otherwise(F.concat(done, F.array(x)))
    return F.when(F.size(parts) < 2, parts).otherwise(
        F.aggregate(F.slice(ranges, 2, F.size(ranges)), F.slice(ranges, 1, 1), add))


def repeated_ranges(docs: DataFrame, keep: str = "none", length: int = LENGTH, k: int = CORE,
                    max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """``row, lo, hi``: byte ranges to remove (they may overlap).  ``docs``:
    doc_id, text, row (what tells the rows apart)."""
    spark = docs.sparkSession
    ordered = keep == "first"
    where = F.struct("doc_id", "row", "at")
    sent = docs.mapInArrow(_hashed(length, k, ordered), CLASS + WHERE * ordered).repartition("core")
    # one shuffle by core serves the count of classes and of a core's classes
    least = F.min(F.struct("doc_id", "row", "at", "place")) if ordered else F.min("place")
    classes = (sent.groupBy("core", "ctx").agg(F.sum("n").alias("n"), least.alias("first"))
               .withColumn("d", F.count(F.lit(1)).over(Window.partitionBy("core"))).filter("d > 1 OR n > 1"))
    classes = materialize(classes.withColumn("place", F.col("first.place") if ordered else F.col("first")), "classes")

    def shipped(some):
        shared = spark.sparkContext.broadcast((bitmap(some.select("core").distinct(), F.col("core"), FILTER_BITS),
                                               bitmap(some, F.col("place"), FILTER_BITS)))
        return shared, docs.mapInArrow(_contexts(length, k, shared), CONTEXTS)

    _, few = shipped(classes.filter(F.col("d").between(2, max_contexts)))
    found = few.repartition("core").sortWithinPartitions("core").mapInArrow(_factors(length - k, ordered), RANGES)
    shared, many = shipped(classes.filter(F.col("d") > max_contexts))
    if shared.value[0].any():                                 # else no core has that many
        found = found.union(_hot_ranges(many, length - k, ordered))

    some = (found.groupBy("core", "ctx").agg(F.collect_set(F.struct("near", "far")).alias("parts"))
            .select("core", "ctx", _joined(F.col("parts")).alias("parts")))
    if ordered:
        verdict = (classes.join(some, ["core", "ctx"], "left").filter(F.col("parts").isNotNull() | (F.col("n") > 1))
                   .select("core", "ctx", "first", "parts"))
    else:       # a class of two or more goes as a whole: no parts
        none = F.lit(None).cast(some.schema["parts"].dataType).alias("parts")
        verdict = classes.filter("n > 1").select("core", "ctx", none).union(
            classes.filter("n = 1").select("core", "ctx").join(some, ["core", "ctx"]))
    verdict = materialize(verdict, "verdicts")
    known = spark.sparkContext.broadcast(bitmap(verdict, F.col("ctx"), FILTER_BITS))
    again = docs.mapInArrow(_known(length, k, known),
                            "core long, ctx long, doc_id long, row long, at int, lo int, hi int")
    hit = again.join(verdict, ["core", "ctx"])                # adaptive execution splits large keys
    here = F.struct("doc_id", "row", "at")
    own = F.struct("first.doc_id", "first.row", "first.at") if ordered else None
    whole = here != own if ordered else F.col("parts").isNull()
    parts = F.transform("parts", lambda p: F.struct((F.col("at") - p["far"]).alias("lo"),
                                                    (F.col("at") - p["near"] + F.lit(length)).alias("hi")))
    spans = F.when(whole, F.array(F.struct(F.col("lo"), F.col("hi")))).otherwise(parts)
    return hit.select("row", F.explode(spans).alias("s")).select("row", "s.lo", "s.hi")


def _known(length: int, k: int, shared):
    """Pass 3: anchors whose context hash passes a bitmap."""
    def run(batches):
        for b in batches:
            ids, hashes = _column(b, "doc_id").cast(pa.int64()), _column(b, "row").to_numpy()
            for t in text_slices(b):
                a = Anchors(t, length, k)
                at = np.flatnonzero(contains(shared.value, a.ctx))
                rows, base = a.text[at] + t.rows.start, t.starts[a.text[at]]
                small = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(a.core[at])), pa.array(signed(a.ctx[at])), ids.take(pa.array(rows)),
                     pa.array(hashes[rows]), small(a.at[at] - base), small(a.lo[at] - base), small(a.hi[at] - base)],
                    names=["core", "ctx", "doc_id", "row", "at", "lo", "hi"])
    return run


def _touched(shared, inside: bool):
    """Rows whose key passes a bitmap, or the others."""
    def run(batches):
        for b in batches:
            ok = contains(shared.value, _column(b, "row").to_numpy().view(np.uint64))
            yield b.filter(pa.array(ok if inside else ~ok))
    return run


def _merged(batches):
    """Each row's ranges sorted, those that meet as one."""
    for b in batches:
        lows, highs = [], []
        for lo, hi in zip(_column(b, "lo").to_pylist(), _column(b, "hi").to_pylist()):
            lo, hi = np.array(lo, np.int64), np.array(hi, np.int64)
            order = np.argsort(lo)
            lo, reach = lo[order], np.maximum.accumulate(hi[order])
            cut = np.flatnonzero(lo[1:] > reach[:-1])
            lows.append(lo[np.r_[0, cut + 1]])
            highs.append(reach[np.r_[cut, len(lo) - 1]])
        yield pa.RecordBatch.from_arrays([_column(b, "row"), pa.array(lows, pa.list_(pa.int32())),
                                          pa.array(highs, pa.list_(pa.int32()))], names=["row", "lo", "hi"])


def _cut(digest: bool):
    """Remove each text's ranges."""
    def run(batches):
        for b in batches:
            lows, highs = (_column(b, c).to_pylist() if c in b.schema.names else [None] * b.num_rows
                           for c in ("lo", "hi"))
            n_bytes, n_removed, n_spans, kept, spans = [], [], [], [], []
            for t in text_slices(b):
                for i in range(len(t)):
                    raw, at = t.raw(i), t.rows.start + i
                    parts, reach, out = [], 0, []
                    for lo, hi in sorted(zip(lows[at] or (), highs[at] or ())):
                        if parts and lo <= parts[-1][1]:
                            parts[-1][1] = max(parts[-1][1], hi)
                        else:
                            parts.append([lo, hi])
                    for lo, hi in parts:
                        out.append(raw[reach:lo])
                        reach = hi
                    out.append(raw[reach:])
                    rest = b"".join(out)
                    n_bytes.append(len(raw))
                    n_removed.append(len(raw) - len(rest))
                    n_spans.append(len(parts))
                    kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
                    spans.append(parts)
            cols = [_column(b, "doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(n_spans, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"]
            if not digest:
                cols.append(pa.array(spans, pa.list_(pa.list_(pa.int64()))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def suffix_dedup(docs: DataFrame, keep: str = "none", digest: bool = False, length: int = LENGTH,
                 k: int = CORE, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, n_bytes, n_removed,
    n_spans`` and the remaining bytes with their removed ``spans``, or the
    SHA-256 of the remaining bytes."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    spark = ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       row_hash().alias("row"))
    spans = materialize(repeated_ranges(slim, keep, length, k, max_contexts).groupBy("row")
                        .agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
                        .mapInArrow(_merged, "row long, lo array<int>, hi array<int>"), "spans")
    last = "kept_sha256 string" if digest else "kept binary, spans array<array<long>>"
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, " + last
    # only texts that may lose something are shuffled to their ranges
    some = spark.sparkContext.broadcast(bitmap(spans, F.col("row"), FILTER_BITS))
    whole = slim.mapInArrow(_touched(some, False), slim.schema).mapInArrow(_cut(digest), out)
    both = slim.mapInArrow(_touched(some, True), slim.schema).join(spans.hint("shuffle_hash"), "row", "left")
    return whole.union(both.select("doc_id", "text", "lo", "hi").mapInArrow(_cut(digest), out))


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
