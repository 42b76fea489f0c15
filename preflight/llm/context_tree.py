"""Operator 12 — code length of texts by context-tree weighting.

A text is its bytes (A-Z in lower case) and an end mark, after ``DEPTH`` marks
(byte 0xFF, which no text holds).  A byte is eight binary decisions; decision
``node`` (1 to 255, the bits before it behind a leading one) has a context tree
over the bytes before, the nearest first.  A context's zeros and ones, as
counted in the training texts, give its Krichevsky-Trofimov estimate Pe; its
weighted probability is Pw = Pe at depth ``DEPTH`` and (Pe + product of the
children's Pw) / 2 above.  The probability of a bit mixes the estimates of
all depths with the weights that follow: a context stops with Pe / (2 Pw).
Counts are fixed by training; a scored text does not change them.

Plan:

* One scan counts, within each task first, the strings of ``DEPTH`` + 1 bytes
  and the words (by a 64-bit hash) of all texts; Spark adds up the tasks.
  The rest of the model works on distinct strings only.
* Strings are dealt by their nearest ``MIDDLE`` bytes, so that a group has at
  most 256^3 strings whatever the corpus; it folds its trees up to that
  depth.  One row per context and decision goes on, dealt by the nearest byte;
  the last fold, at most 65,280 rows, is made on the driver.  Then the mixtures
  go down the same way and give every string its probability, strings that
  only held-out texts hold included.
* A second scan adds up each text.  The values of the most frequent strings
  and words, at most ``FREQUENT`` of either, go to every task (a fixed size);
  all others are joined by key.

Cases: null and empty texts have one token and one mark.  Without training
texts every bit costs a bit, and the base score of any token is 0.  A row
without doc_id is neither held out nor learned from.  Repeated rows count and
are scored one by one; texts of any length are read whole.  No documents give
no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preflight.llm.arrow_text import ASCII_LOWER, SPACE, RangeHash, Texts, give_back, lean, runs, text_slices
from preflight.llm.joins import least_of_frequent
from preflight.llm.ship import ship
from preflight.session import materialize

DEPTH, MIDDLE = 5, 3
#: Strings, and words, whose values are sent to every task (16 bytes each).
FREQUENT = 1 << 19
#: Strings of a group of the model, as expected.
GROUP = 1 << 17
#: Keys that a task holds before it sends what it has counted.
HELD = 800_000
#: Bytes of text that a task scores at once.
SLICE = 1 << 19

MARK = 0xFF
HALF = np.log(0.5)
WORD = np.uint64(1 << 63)      # set in a word's key: as a LONG it is negative, a string's key is not


def strings(t: Texts) -> np.ndarray:
    """Every string of ``DEPTH`` + 1 bytes of a slice, one per byte and end
    mark, text by text.  The context's nearest byte is the highest, the byte
    itself the lowest."""
    n = len(t)
    size = t.ends - t.starts
    first = t.starts + np.arange(n) * (DEPTH + 1)
    x = np.full(len(t.data) + n * (DEPTH + 1) + DEPTH, MARK, np.int64)
    owner = np.repeat(np.arange(n), size)
    x[np.arange(len(t.data)) + owner * (DEPTH + 1) + DEPTH] = ASCII_LOWER[t.data]
    g = x[DEPTH:].copy()
    for d in range(1, DEPTH + 1):
        g |= x[DEPTH - d:len(x) - d] << (8 * (DEPTH + 1 - d))
    keep = np.ones(len(g), bool)
    # between texts: the places of the next text's first marks
    for d in range(1, DEPTH + 1):
        keep[first + size + d] = False
    return g[keep]


def words(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a slice's words, and their number by text."""
    lower = ASCII_LOWER[t.data]
    starts, ends, counts = runs(t, ~SPACE)
    return RangeHash(lower)(starts, ends) | WORD, counts


# --- counts ----------------------------------------------------------------

def _merge(parts):
    key = np.concatenate([k for k, _ in parts])
    order = np.argsort(key)
    key, n = key[order], np.concatenate([x for _, x in parts])[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at], np.add.reduceat(n, at)


def _count(batches):
    """``(key, n)``: keys of this task's texts and their training occurrences."""
    parts, held = [], 0

    def out():
        key, n = _merge(parts)
        for lo in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[lo:lo + (1 << 16)].view(np.int64)), pa.array(n[lo:lo + (1 << 16)])],
                                             names=["key", "n"])

    for b in batches:
        train = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for t in text_slices(b):
            learn = train[t.rows.start:t.rows.stop]
            for key, per in ((strings(t).view(np.uint64), t.ends - t.starts + 1), words(t)):
                mine = np.repeat(learn, per)
                for part, times in ((key[mine], 1), (key[~mine], 0)):
                    if len(part):
                        k, c = np.unique(part, return_counts=True)
                        parts.append((k, c * times))
                        held += len(k)
            if held > HELD:
                parts[:] = [_merge(parts)]
                held = len(parts[0][0])
                if 2 * held > HELD:
                    yield from out()
                    parts.clear()
                    held = 0
    if parts:
        yield from out()


# --- the trees ---------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5: Stirling's series at x + 8."""
    z = x + 8
    low = np.log(x)
    for k in range(1, 8):
        low += np.log(x + k)
    i = 1 / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i / 1680))) - low


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """Contexts of one depth: sorted keys (decision, bytes, the nearest
    highest), counts, and the children's summed ln Pw (none at ``DEPTH``)."""

    def __init__(self, key, n0, n1, child=None):
        self.key, self.n0, self.n1 = key, n0, n1
        pe = kt(n0, n1)
        if child is None:
            self.pw, self.stop, self.go = pe, np.ones(len(key)), np.zeros(len(key))
        else:
            self.pw = np.logaddexp(pe, child) + HALF
            self.stop, self.go = np.exp(pe + HALF - self.pw), np.exp(child + HALF - self.pw)
        self.child = child

    def up(self) -> tuple["Level", np.ndarray]:
        """The level above, and each context's place in it."""
        key = self.key >> 8
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        add = lambda x: np.add.reduceat(x, at) if len(at) else x
        return Level(key[at], add(self.n0), add(self.n1), add(self.pw)), np.cumsum(new) - 1

    def mix(self, one, zero, rest):
        """Mixtures of the depths above (by context): this depth added."""
        n = self.n0 + self.n1 + 1.0
        w = rest * self.stop
        return one + w * (self.n1 + 0.5) / n, zero + w * (self.n0 + 0.5) / n, rest * self.go


def levels(bottom: Level, n: int):
    """``bottom`` and ``n`` levels above it, the topmost first, each with its
    contexts' places in the level above."""
    out = [(bottom, None)]
    for _ in range(n):
        top, at = out[0][0].up()
        out[0] = (out[0][0], at)
        out.insert(0, (top, None))
    return out


def decisions(key: np.ndarray, n: np.ndarray) -> tuple[Level, list[np.ndarray], np.ndarray]:
    """Contexts of ``DEPTH`` of sorted strings; for each of the eight bits the
    strings' places in them; and the bits."""
    byte, ctx = key & 255, key >> 8
    rows, inverse, lo = [], [], 0
    bits = np.empty((8, len(key)), bool)
    for k in range(8):
        node = (1 << k) | (byte >> (8 - k))
        bits[k] = (byte >> (7 - k)) & 1 == 1
        own = ctx << 8 | node                       # sorted, as the strings are
        new = np.ones(len(key), bool)
        new[1:] = own[1:] != own[:-1]
        at = np.flatnonzero(new)
        rows.append((node[at] << 8 * DEPTH | ctx[at], np.add.reduceat(np.where(bits[k], 0, n), at),
                     np.add.reduceat(np.where(bits[k], n, 0), at)))
        inverse.append(np.cumsum(new) - 1 + lo)
        lo += len(at)
    all_keys, n0, n1 = (np.concatenate(x) for x in zip(*rows))
    order = np.argsort(all_keys, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return Level(all_keys[order], n0[order], n1[order]), [back[i] for i in inverse], bits


def _sorted(table: pa.Table, *names):
    cols = [table[c].to_numpy() for c in names]
    order = np.argsort(cols[0], kind="stable")
    return [c[order] for c in cols]


CONTEXTS = "key long, n0 long, n1 long, child double"


def _contexts(level: Level) -> pa.Table:
    return pa.table({"key": level.key, "n0": level.n0, "n1": level.n1, "child": level.child})


def _fold_strings(table: pa.Table) -> pa.Table:
    key, n = _sorted(table, "key", "n")
    return _contexts(levels(decisions(key, n)[0], DEPTH - MIDDLE)[0][0])


def _fold_contexts(table: pa.Table) -> pa.Table:
    return _contexts(levels(Level(*_sorted(table, "key", "n0", "n1", "child")), MIDDLE - 1)[0][0])


def _down(ladder, one, zero, rest):
    """Mixtures at the foot of a ladder of levels from those of its top."""
    for level, at in ladder[1:]:
        one, zero, rest = level.mix(one[at], zero[at], rest[at])
    return one, zero, rest


def _mix_contexts(first):
    """Mixtures of the middle depth, from those of depth 1."""
    keys, *mixed = first

    def run(table: pa.Table) -> pa.Table:
        ladder = levels(Level(*_sorted(table, "key", "n0", "n1", "child")), MIDDLE - 1)
        at = np.searchsorted(keys, ladder[0][0].key)
        one, zero, rest = _down(ladder, *(m[at] for m in mixed))
        return pa.table({"key": ladder[-1][0].key, "one": one, "zero": zero, "rest": rest})
    return run


def _values(strings_of: pa.Table, mixed: pa.Table) -> pa.Table:
    """log10 probability of every string of a group."""
    key, n = _sorted(strings_of, "key", "n")
    bottom, places, bits = decisions(key, n)
    ladder = levels(bottom, DEPTH - MIDDLE)
    known, *m = _sorted(mixed, "key", "one", "zero", "rest")
    at = np.searchsorted(known, ladder[0][0].key)
    one, zero, _ = _down(ladder, *(x[at] for x in m))
    one, zero = np.log10(one), np.log10(zero)
    value = np.zeros(len(key))
    for k in range(8):
        value += np.where(bits[k], one[places[k]], zero[places[k]])
    give_back()
    return pa.table({"key": key, "n": n, "val": value})


def tree_values(counts: DataFrame, n_strings: int) -> DataFrame:
    """``(key, n, val)``: log10 probability of the last byte of each counted
    string after the bytes before it."""
    groups = max(1, n_strings // GROUP)
    near = lambda ctx: F.pmod(F.xxhash64(ctx), F.lit(groups)).cast("int").alias("part")
    own = counts.select("key", "n", near(F.shiftright("key", 8 * (DEPTH + 1 - MIDDLE))))
    ctx = F.col("key").bitwiseAND(F.lit((1 << 8 * MIDDLE) - 1).cast("long"))
    middle = materialize(own.groupBy("part").applyInArrow(_fold_strings, CONTEXTS), "tree-middle")
    nearest = F.shiftright(ctx, 8 * (MIDDLE - 1)).alias("nearest")
    grouped = middle.select("*", nearest).groupBy("nearest")
    # a row per decision and nearest byte: at most 255 * 256
    first = Level(*_sorted(grouped.applyInArrow(_fold_contexts, CONTEXTS).toArrow(), "key", "n0", "n1", "child"))
    root, at = first.up()
    mixed = root.mix(np.zeros(len(root.key)), np.zeros(len(root.key)), np.ones(len(root.key)))
    start = (first.key, *first.mix(*(m[at] for m in mixed)))
    middle = grouped.applyInArrow(_mix_contexts(start), "key long, one double, zero double, rest double").select(
        "*", near(ctx))
    return own.groupBy("part").cogroup(middle.groupBy("part")).applyInArrow(_values, "key long, n long, val double")


# --- scores --------------------------------------------------------------------

class Table:
    """Values by key, with open addressing."""

    def __init__(self, key: np.ndarray, val: np.ndarray):
        bits = max(4, (2 * max(len(key), 1) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.val = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.key[slot] == -1
            self.key[slot[free]] = key[todo[free]]            # of several, the last stays
            done = self.key[slot] == key[todo]
            self.val[slot[done]] = val[todo[done]]
            slot, todo = (slot[~done] + 1) & self.mask, todo[~done]

    def _slot(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys have one."""
        slot = self._slot(key)
        has = self.key[slot] == key
        out = self.val[slot]
        todo = np.flatnonzero(~has & (self.key[slot] != -1))
        out[~has] = 0
        slot = (slot[todo] + 1) & self.mask
        while len(todo):
            hit = self.key[slot] == key[todo]
            has[todo[hit]] = True
            out[todo[hit]] = self.val[slot[hit]]
            on = ~hit & (self.key[slot] != -1)
            slot, todo = (slot[on] + 1) & self.mask, todo[on]
        return out, has


def _score(shared):
    def run(batches):
        top_strings, top_words, unknown = shared.value
        by_string, by_word = Table(*top_strings), Table(*top_words)
        for b in batches:
            for t in text_slices(b, limit=SLICE):
                n = len(t)
                head = [b.column(i).slice(t.rows.start, n) for i in range(b.num_columns - 1)]
                lost, cols = [], []
                for table, (key, per) in ((by_string, (strings(t), t.ends - t.starts + 1)), (by_word, words(t))):
                    key = key.view(np.int64)
                    val, has = table.get(key)
                    doc = np.repeat(np.arange(n), per)
                    cols.append(np.bincount(doc, val, n))
                    if table is by_word:
                        cols += [np.bincount(doc[has], val[has] > unknown, n).astype(np.int64), per.astype(np.int64)]
                    lost.append((doc[~has], key[~has]))
                doc, key = (np.concatenate(x) for x in zip(*lost))
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(key)))
                off = pa.array(np.searchsorted(doc[at], np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*head, pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3]),
                     pa.ListArray.from_arrays(off, pa.array(key[at])), pa.ListArray.from_arrays(off, pa.array(times))],
                    names=[*b.schema.names[:-1], "score", "base", "known", "n_words", "rest", "times"])
    return run


def score(df: DataFrame, train: Column, limit: int | None = None) -> DataFrame:
    """One row per document (``doc_id``, ``text``): ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (unigrams of words, add-one),
    ``score`` (log10 probability of the text by context-tree weighting),
    ``code_bits`` (its code length) and ``bits_per_byte`` (null without bytes).
    The model learns from the rows where ``train`` holds."""
    spark = ship(df.sparkSession)
    limit = FREQUENT if limit is None else limit
    train = F.coalesce(train, F.lit(False))
    n_docs = df.agg(F.count(F.when(train, 1))).first()[0]
    counts = df.select(train.alias("train"), "text").select("text", "train").mapInArrow(lean(_count), "key long, n long")
    counts = materialize(counts.groupBy("key").agg(F.sum("n").alias("n")), "ctw-counts")
    facts = counts.agg(F.count(F.when(F.col("key") >= 0, 1)), F.sum(F.when(F.col("key") < 0, F.col("n"))),
                       F.count(F.when((F.col("key") < 0) & (F.col("n") > 0), 1))).first()
    n_strings, tokens, distinct = facts[0], (facts[1] or 0) + n_docs, facts[2] + (n_docs > 0)
    base = lambda c: float(np.log10((c + 1) / (tokens + distinct + 1)))
    by_word = counts.filter("key < 0").select("key", "n", F.log10(
        (F.col("n") + 1).cast("double") / F.lit(float(tokens + distinct + 1))).alias("val"))
    by_string = materialize(tree_values(counts.filter("key >= 0"), n_strings), "ctw-values")
    least = [least_of_frequent(x, limit) for x in (by_string, by_word)]
    top = [x.filter(F.col("n") >= m).select("key", "val").toArrow() for x, m in zip((by_string, by_word), least)]
    unknown = base(0) + 1e-9        # the value of any known word is larger
    shared = spark.sparkContext.broadcast((*((x["key"].to_numpy(), x["val"].to_numpy()) for x in top), unknown))
    kind = df.schema["doc_id"].dataType.simpleString()
    slim = df.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                     F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = slim.mapInArrow(lean(_score(shared)), f"row long, doc_id {kind}, n_bytes long, score double, base double, known long, "
                          "n_words long, rest array<long>, times array<long>")
    if any(m > 0 for m in least):
        out = materialize(out, "ctw-scored")
        each = (out.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x"))
                .select("row", F.col("x.rest").alias("key"), F.col("x.times").alias("t")))
        values = (by_string.filter(F.col("n") < least[0]).select("key", "val", F.lit(0).alias("known"))
                  .unionByName(by_word.filter(F.col("n") < least[1]).select("key", "val", (F.col("n") > 0).cast("int").alias("known"))))
        worth, word = F.col("t") * F.col("val"), F.col("key") < 0
        more = each.join(values, "key").groupBy("row").agg(
            F.sum(F.when(~word, worth)).alias("s"), F.sum(F.when(word, worth)).alias("b"),
            F.sum(F.col("t") * F.col("known")).alias("k"))
        out = out.join(more, "row", "left")
        for c, x in (("score", "s"), ("base", "b"), ("known", "k")):
            out = out.withColumn(c, F.col(c) + F.coalesce(x, F.lit(0)))
    bits = -F.col("score") * F.lit(float(np.log2(10)))
    return out.select(
        "doc_id", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.lit(base(n_docs))).alias("base_score"), "score",
        bits.alias("code_bits"), F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).alias("bits_per_byte"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def op12_context_tree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, ~held_out())
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), *out.columns[1:])
