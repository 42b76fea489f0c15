"""Operator 9 — benchmark decontamination by winnowing.

Words are maximal runs of digits, letters a-z (A-Z lowered) and non-ASCII
characters.  Every span of ``window`` (10) consecutive words holds, among its
k-grams (k = 5), a minimum hash that depends on the span alone; keeping
the rightmost minimum of every 6 consecutive k-grams therefore keeps one
common fingerprint inside every span of 10 words that a document shares
with an item.  Documents and items are joined on fingerprints, each hit is
extended word by word to both sides, and runs of at least 10 equal words
are hits.  An item of fewer than 10 words has no full span; the whole item
is one window and is joined on its own length.

Plan: one pass over the texts keeps only fingerprints that a bounded
bitmap of the items' fingerprints lets through (every fingerprint of an
item passes); those few are joined, salted by document, so that a passage
found in a third of all documents is spread over the tasks.

Cases: null or wordless texts and items have no words, no windows and no
hits; repeated documents each get their row; items of equal words are
joined once and listed all; a null item_id hits words but is not listed;
a null doc_id is a document of its own text; texts of any length are read
whole; without documents the result is empty, without items nothing is hit.
Other columns are ignored (``clean`` passes them through; names that begin with
``__`` are reserved).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflight.llm.arrow_text import (ASCII_LOWER, RangeHash, lean, mask, runs, signed, text_slices,
                                      window_hash)
from preflight.llm.filters import bitmap, contains
from preflight.llm.joins import row_hash
from preflight.llm.ship import ship
from preflight.session import materialize

WORD = mask(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
WINDOW, GRAM = 10, 5
REACH = WINDOW - GRAM
SPAN = GRAM + 2 * REACH
SALTS = 16

PRINTS = ("id long, thash long, n_words int, seq binary, fp array<long>, pos array<int>, "
          "ctx array<long>, short_key array<long>, short_len array<int>, short_pos array<int>")


def select(grams: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """Winnowing: the rightmost minimum of every ``w`` consecutive grams
    whose start is ``ok``; positions, each once."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        g = grams[j:j + n]
        low = g <= best
        best = np.where(low, g, best)
        at[low] = j
    at += np.arange(n)
    return np.unique(at[ok[:n]])


def fingerprints(id_column: str, words=None, lengths=(), missing: int = 0, is_item: bool = False):
    """mapInArrow function: the fingerprints of each text with their word
    contexts; with ``words`` (a bitmap) only those that may be an item's.
    ``lengths``: window lengths of short items to look for."""
    def run(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index(id_column))
            keys_of = b.column(b.schema.get_field_index("thash"))
            for t in text_slices(b):
                low = ASCII_LOWER[t.data]
                t.data = low
                s, e, counts = runs(t, WORD)
                hasher = RangeHash(low)
                h = hasher(s, e)
                ends = np.cumsum(counts)
                last = np.repeat(ends, counts)            # end of each word's document
                first = last - np.repeat(counts, counts)
                n = len(h)
                grams = window_hash(h, GRAM)
                ok = np.zeros(max(len(grams) - REACH, 0), bool)
                if len(ok):
                    ok = np.arange(len(ok)) + WINDOW <= last[:len(ok)]
                at = select(grams, ok, REACH + 1)
                if words is not None and len(at):
                    at = at[contains(words, grams[at])]
                around = at[:, None] + np.arange(-REACH, GRAM + REACH)[None, :]
                inside = (around >= first[at][:, None]) & (around < last[at][:, None]) if len(at) \
                    else np.zeros((0, SPAN), bool)
                ctx = np.where(inside, h[np.clip(around, 0, max(n - 1, 0))] if len(at)
                               else np.zeros((0, SPAN), np.uint64), np.uint64(missing))
                per = np.searchsorted(at, ends) - np.searchsorted(at, ends - counts)
                keys, lens, poss = [], [], []
                for length in (range(1, WINDOW) if is_item else lengths):
                    g = window_hash(h, length) + np.uint64(length)
                    fits = np.arange(len(g)) + length <= last[:len(g)] if len(g) else np.zeros(0, bool)
                    if is_item:
                        fits &= (last - first == length)[:len(g)] if len(g) else fits
                    elif words is not None:
                        fits &= contains(words, g)
                    p = np.flatnonzero(fits)
                    keys.append(g[p])
                    lens.append(np.full(len(p), length, np.int32))
                    poss.append(p)
                sk = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                sl = np.concatenate(lens) if lens else np.zeros(0, np.int32)
                sp = np.concatenate(poss) if poss else np.zeros(0, np.int64)
                order = np.argsort(sp, kind="stable")
                sk, sl, sp = sk[order], sl[order], sp[order]
                sper = np.searchsorted(sp, ends) - np.searchsorted(sp, ends - counts)

                def lists(values, n_each, kind):
                    off = np.concatenate([[0], np.cumsum(n_each)]).astype(np.int32)
                    return pa.ListArray.from_arrays(off, pa.array(values, kind))

                base = first[at] if len(at) else at
                sbase = first[sp] if len(sp) else sp
                seqs = [h[x:y].tobytes() if is_item else None for x, y in zip(ends - counts, ends)]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(t.rows.start, len(t)).cast(pa.int64()), keys_of.slice(t.rows.start, len(t)),
                    pa.array(counts.astype(np.int32)), pa.array(seqs, pa.binary()),
                    lists(signed(grams[at]) if len(at) else np.zeros(0, np.int64), per, pa.int64()),
                    lists((at - base).astype(np.int32), per, pa.int32()),
                    lists(signed(np.ascontiguousarray(ctx).reshape(-1)), per * SPAN, pa.int64()),
                    lists(signed(sk), sper, pa.int64()), lists(sl, sper, pa.int32()),
                    lists((sp - sbase).astype(np.int32), sper, pa.int32())],
                    names=[c.split()[0] for c in PRINTS.split(", ")])
    return run


def _extend(batches):
    """Keep joined fingerprints whose equal words reach to 10 or more."""
    for b in batches:
        t = pa.Table.from_batches([b])
        n = t.num_rows
        if not n:
            continue
        take = lambda c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, SPAN)
        same = take("ctx") == take("item_ctx")
        left = np.cumprod(same[:, :REACH][:, ::-1], axis=1).sum(1)
        right = np.cumprod(same[:, GRAM + REACH:], axis=1).sum(1)
        good = same[:, REACH:REACH + GRAM].all(1) & (left + right >= REACH)
        pos = t["pos"].to_numpy()
        out = t.select(["id", "thash", "cls"])
        out = out.append_column("lo", pa.array((pos - left).astype(np.int32)))
        out = out.append_column("hi", pa.array((pos + GRAM + right).astype(np.int32)))
        yield from out.filter(pa.array(good)).to_batches()


def _covered(batches):
    """Number of distinct words in a document's hit intervals."""
    for b in batches:
        t = b.to_pydict()
        n_hit = []
        for lo, hi in zip(t["lo"], t["hi"]):
            total, reach = 0, 0
            for x, y in sorted(zip(lo, hi)):
                total += max(0, y - max(x, reach))
                reach = max(reach, y)
            n_hit.append(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(t["id"], pa.int64()), pa.array(t["thash"], pa.int64()),
             pa.array(n_hit, pa.int64())], names=["id", "thash", "n_hit"])


def hits(docs: DataFrame, benchmark: DataFrame, filter_bits: int = 24):
    """(documents: ``id, thash, n_words``; hit intervals: ``id, thash, cls,
    lo, hi`` in words; item classes: ``cls, item_id``)."""
    ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", F.xxhash64("text").alias("thash"))
    b = materialize(items.mapInArrow(lean(fingerprints("item_id", missing=1, is_item=True)), PRINTS)
                    .filter("n_words > 0").withColumn("cls", F.sha2("seq", 256)), "items")
    classes = b.select("cls", F.col("id").alias("item_id")).distinct()
    # items of the same words once
    one = b.dropDuplicates(["cls"])
    slides = F.sequence(F.lit(0), F.size("fp") - 1)
    part = lambda c: F.transform(slides, lambda i: F.struct(
        F.element_at("fp", i + 1).alias("fp"), F.element_at("pos", i + 1).alias("pos"),
        F.slice("ctx", i * SPAN + 1, SPAN).alias(c)))
    bfp = one.filter(F.size("fp") > 0).select("cls", F.explode(part("item_ctx")).alias("x")).select(
        "cls", "x.fp", "x.item_ctx")
    short = one.filter(F.size("short_key") > 0).select(
        "cls", F.element_at("short_key", 1).alias("key"), F.element_at("short_len", 1).alias("len"))
    lengths = [r["len"] for r in short.select("len").distinct().collect()]     # nine at most
    words = bitmap(bfp.select(F.col("fp").alias("h")).union(short.select(F.col("key").alias("h"))),
                   F.col("h"), filter_bits)

    d = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_hash().alias("thash"))
                    .mapInArrow(lean(fingerprints("doc_id", words, sorted(lengths))), PRINTS)
                    .drop("seq"), "prints")
    dfp = d.filter(F.size("fp") > 0).select("id", "thash", F.explode(part("ctx")).alias("x")).select(
        "id", "thash", "x.fp", "x.pos", "x.ctx",
        F.pmod(F.hash("id", "thash"), F.lit(SALTS)).alias("salt"))
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    long_hits = (dfp.join(bfp.select("*", salts), ["fp", "salt"])
                 .select("id", "thash", "cls", "pos", "ctx", "item_ctx")
                 .mapInArrow(lean(_extend), "id long, thash long, cls string, lo int, hi int"))
    z = F.explode(F.arrays_zip("short_key", "short_len", "short_pos")).alias("x")
    dsh = d.filter(F.size("short_key") > 0).select("id", "thash", z).select(
        "id", "thash", F.col("x.short_key").alias("key"), F.col("x.short_len").alias("len"),
        F.col("x.short_pos").alias("lo"), F.pmod(F.hash("id", "thash"), F.lit(SALTS)).alias("salt"))
    short_hits = (dsh.join(short.select("*", salts), ["key", "len", "salt"])
                  .select("id", "thash", "cls", "lo", (F.col("lo") + F.col("len")).alias("hi")))
    return d.select("id", "thash", "n_words"), long_hits.union(short_hits), classes


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones, all columns."""
    _, found, _ = hits(docs, benchmark)
    bad = materialize(found.select(F.col("thash").alias("__row")).distinct(), "contaminated")
    return (docs.withColumn("__row", row_hash()).join(bad.hint("shuffle_hash"), "__row", "left_anti")
            .drop("__row"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, one
    row for each row of ``docs`` (needs doc_id and text)."""
    d, found, classes = hits(docs, benchmark)
    found = materialize(found.distinct(), "hits")
    key = ["id", "thash"]
    cover = (found.select("id", "thash", "lo", "hi").distinct().groupBy(*key)
             .agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
             .mapInArrow(lean(_covered), "id long, thash long, n_hit long"))
    listed = (found.select("id", "thash", "cls").distinct().join(classes, "cls")
              .filter(F.col("item_id").isNotNull())
              .select("id", "thash", F.col("item_id").cast("string").alias("item")).distinct()
              .groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items")))
    a, c, i = d.alias("a"), cover.alias("c"), listed.alias("i")
    same = lambda x: F.col(f"a.id").eqNullSafe(F.col(f"{x}.id")) & (F.col("a.thash") == F.col(f"{x}.thash"))
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return (a.join(c, same("c"), "left").join(i, same("i"), "left").select(
        F.col("a.id").alias("doc_id"), F.col("a.n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated")))


def op9_decontaminate(spark, sf_dir):
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                         spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
