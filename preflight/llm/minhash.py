"""Operator 4 — near-duplicates by SuperMinHash.

A text's set is its distinct shingles of five words (64-bit hashes of
whole words).  Element x takes the signature's 128 places in an order of
its own - a permutation drawn from x - and puts ``rank + u``, u uniform in
[0, 1), on each; a place keeps its minimum.  The ranks of one element are
a permutation, so its values are negatively correlated, which lowers the
variance of plain MinHash.  All elements take their place of rank j before
any takes rank j + 1; a text stops early once all places hold less than
the next rank.  Every text's permutation is affine in the rank
(start + rank * odd step mod 128): it needs no table per element.

32 bands of 4 rows: two texts of similarity 0.85 share no band with a
probability of 5e-11.  Texts of equal sets are one class from the first
shuffle on.  A bitmap rules out most buckets of one class before they are
counted.  Of the classes that share a bucket, a twice-seen filter over
all their shingles tells how many shingles of a class may be in another
one at all (``c`` of ``n``); a class with 100 c < 85 n has no link.  This is
exact: it removes copies that were changed too much, and texts that only
share a passage.

Families - classes that buckets connect, linked or not - are cut into blocks
of about ``BLOCK`` classes; each pair of blocks is one group, whose sets are
compared by matrix products and which returns stars of linked classes.  No
pair of texts is ever a row, no group grows with a family, and no pair of a
family is left out.

Cases: a text of one to four words has one shingle, the whole sequence; a
null or wordless text has none and is linked with nothing (it is its own
component); rows of one doc_id are one document of several texts; a null
doc_id takes the smallest id of its component and is never kept; a
component of null ids only has a null id; texts are read whole, however
long; an empty table gives an empty result.  Other columns are ignored
(``deduplicated`` passes them through; names that begin with ``__`` are
reserved).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflight.llm.arrow_text import (ASCII_LOWER, SPACE, RangeHash, Texts, lean, mix, runs, signed,
                                      text_slices, window_hash)
from preflight.llm.components import components
from preflight.llm.filters import PLACES as SENT
from preflight.llm.filters import TwiceSeen, bitmap, contains, places_of_task
from preflight.llm.joins import row_hash, salted_join
from preflight.llm.ship import ship
from preflight.session import materialize

SHINGLE = 5
PLACES, ROWS = 128, 4
BANDS = PLACES // ROWS
PERCENT = 85
FILTER_BITS = 25        # 4 MB
MAX_BITS = 28          # 32 MB
BLOCK = 512             # classes of a block, and
ELEMENTS = 1 << 18      # their shingles (expected numbers; a longer text is alone)
COLUMNS = 4096          # shingles of a matrix product
_U = np.uint64
_RANK = _U(56)


def shingle_sets(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every text, one after the other, and how
    many each has."""
    low = ASCII_LOWER[t.data]
    s, e, counts = runs(Texts(low, t.starts, t.ends, t.rows), ~SPACE)
    words = RangeHash(low)(s, e)
    ends = np.cumsum(counts)
    grams = window_hash(words, SHINGLE)
    out, sizes = [], np.zeros(len(t), np.int64)
    for i, (n, y) in enumerate(zip(counts.tolist(), ends.tolist())):
        if n >= SHINGLE:
            g = grams[y - n:y - SHINGLE + 1].copy()
            g.sort()
            keep = np.ones(len(g), bool)
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            g = g[keep]
        elif n:
            g = mix(window_hash(words[y - n:y], n) + _U(n))
        else:
            continue
        out.append(g)
        sizes[i] = len(g)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def signatures(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SuperMinHash signature of every set (one row each)."""
    n = len(sizes)
    sig = np.full((n, PLACES), ~_U(0))
    flat = sig.reshape(-1)
    row = np.repeat(np.arange(n) * PLACES, sizes)
    own = mix(h ^ _U(0xA0761D6478BD642F))
    start, step = (own & _U(PLACES - 1)).astype(np.int64), ((own >> _U(20)) & _U(PLACES - 1) | _U(1)).astype(np.int64)
    for j in range(PLACES):
        value = (mix(h + _U((j + 1) * 0xE7037ED1A0B428DB % (1 << 64))) >> _U(8)) | (_U(j) << _RANK)
        np.minimum.at(flat, row + ((start + j * step) & (PLACES - 1)), value)
        open_ = sig.max(1) >= (_U(j + 1) << _RANK)
        live = open_[row // PLACES]
        if not live.all():
            if not live.any():
                break
            h, row, start, step = h[live], row[live], start[live], step[live]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    rows = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS))
    for r in range(ROWS):
        key = mix(key * _U(0xD6E8FEB86659FD93) + rows[:, :, r])
    return key


def _signed(batches):
    for b in batches:
        ids = b.column(b.schema.get_field_index("doc_id")).cast(pa.int64())
        for t in text_slices(b):
            h, sizes = shingle_sets(t)
            keys = band_keys(signatures(h, sizes))
            ends = np.cumsum(sizes)
            fps = [xxhash.xxh3_128_digest(h[e - n:e].tobytes()) if n else None for n, e in zip(sizes, ends)]
            some = sizes > 0
            off = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(t.rows.start, len(t)), b.column(b.schema.get_field_index("row")).slice(t.rows.start, len(t)),
                 pa.array(sizes), pa.array(fps, pa.binary()),
                 pa.ListArray.from_arrays(off, pa.array(signed(np.ascontiguousarray(keys[some])).reshape(-1)))],
                names=["id", "row", "n", "fp", "bands"])


def _wanted(shared, b):
    """Rows whose doc_id is null or passes a bitmap."""
    ids = b.column(b.schema.get_field_index("doc_id")).cast(pa.int64())
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    own = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
    return b.filter(pa.array(~known | contains(shared.value, own))).select(["text"])


def _elements(shared, bits_log2: int):
    """Filter places of the wanted texts' shingles."""
    def run(batches):
        def sets():
            for b in batches:
                for t in text_slices(_wanted(shared, b)):
                    yield shingle_sets(t)[0]
        yield from places_of_task(sets(), bits_log2)
    return run


def _sets(shared, seen, percent: int):
    """Sets of the wanted texts that may have a link, with ``c``: how many of
    their shingles may be in another text."""
    def run(batches):
        for b in batches:
            for t in text_slices(_wanted(shared, b)):
                h, sizes = shingle_sets(t)
                ends = np.cumsum(sizes)
                met = np.concatenate([[0], np.cumsum(seen.value.has(h))])
                c = met[ends] - met[ends - sizes]
                some = np.flatnonzero((sizes > 0) & (100 * c >= percent * sizes))
                fps = [xxhash.xxh3_128_digest(h[ends[i] - sizes[i]:ends[i]].tobytes()) for i in some]
                off = np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)
                own = [h[ends[i] - sizes[i]:ends[i]] for i in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fps, pa.binary()), pa.array(sizes[some]), pa.array(c[some]), pa.ListArray.from_arrays(
                        off, pa.array(signed(np.concatenate(own) if own else np.zeros(0, np.uint64))))],
                    names=["fp", "n", "c", "elements"])
    return run


def _ids(batches):
    for b in batches:
        h = mix(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(signed(h))], names=["h"])


def _in_buckets(shared):
    """Band keys that pass a bitmap, one row each."""
    def run(batches):
        for b in batches:
            keys = b.column(b.schema.get_field_index("bands"))
            off = keys.offsets.to_numpy()
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(keys)), np.diff(off))
            ok = contains(shared.value, flat.view(np.uint64))
            at = pa.array(row[ok])
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[ok]), b.column(b.schema.get_field_index("fp")).take(at)], names=["key", "fp"])
    return run


def _block_links(percent: int):
    """Links between a pair of blocks (side 0 and 1; a block with itself has
    side 0 only), by counting common shingles of full sets in matrix
    products.  Comes back as stars: every class that is linked, with the
    first class it is connected to here."""
    def run(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        side = table["side"].to_numpy()
        flat = table["elements"].combine_chunks()
        row = np.repeat(np.arange(len(n)), np.diff(flat.offsets.to_numpy()))
        values, inverse, df = np.unique(flat.flatten().to_numpy(), return_inverse=True, return_counts=True)
        some = df[inverse] > 1
        column = (np.cumsum(df > 1) - 1)[inverse[some]]
        row = row[some]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        both = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            x, y = np.searchsorted(column, [lo, lo + COLUMNS])
            m = np.zeros((len(n), min(COLUMNS, int(column[y - 1]) + 1 - lo) if y > x else 0), np.float32)
            m[row[x:y], column[x:y] - lo] = 1
            both += m[left] @ m[right].T
        linked = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
        label = np.arange(len(n))
        while True:                       # least label along links, until nothing moves
            old = label.copy()
            far = len(n)
            label[right] = np.minimum(label[right], np.where(linked, label[left][:, None], far).min(0, initial=far))
            label[left] = np.minimum(label[left], np.where(linked, label[right][None, :], far).min(1, initial=far))
            label = label[label]
            if (label == old).all():
                break
        fp = table["fp"].combine_chunks()
        at = np.flatnonzero(label != np.arange(len(n)))
        return pa.table({"a": fp.take(pa.array(at)), "b": fp.take(pa.array(label[at]))})
    return run


def _family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that connect what is connected.  A family is what
    buckets connect, linked or not; every link lies inside one.  Families are
    dealt to blocks of about ``BLOCK`` classes and ``ELEMENTS`` shingles at
    most, and every pair of blocks is one group."""
    family = materialize(components(members.select(F.col("fp").alias("a"), F.col("centre").alias("b"))), "families")
    size = (family.join(sets.select(F.col("fp").alias("node"), "n"), "node").groupBy("component")
            .agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / ELEMENTS)).cast("int").alias("blocks")))
    at = salted_join(family, size, ["component"], F.col("node")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = (at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      (F.col("block") > F.col("other")).cast("int").alias("side"), F.col("node").alias("fp")))
    return (spread.join(sets.select("fp", "n", "elements"), "fp")
            .groupBy("component", "i", "j").applyInArrow(_block_links(percent), "a binary, b binary"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``
    (needs doc_id and text); texts are linked from a similarity of
    ``percent`` / 100 on."""
    own, named = families(docs, percent)
    # smallest id of each component, then back to every row
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    ids = salted_join(named, least, ["component"], F.col("fp")).select("fp", "least")
    linked = salted_join(own.filter("n > 0"), ids, ["fp"], F.col("row"), salts=4).select("id", "n", "least")
    alone = own.filter("n = 0").select("id", "n", F.col("id").alias("least"))
    return linked.union(alone).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"),
        F.coalesce(F.col("id") == F.col("least"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component, all columns: that of its smallest
    doc_id (nulls last; between texts of one id by hash).  Texts without
    words all stay."""
    own, named = families(docs, percent)
    at = salted_join(own.filter("n > 0"), named.select("fp", "component"), ["fp"], F.col("row"), salts=4)
    best = at.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("x"))
    stays = materialize(best.select(F.col("x.row").alias("row")).union(own.filter("n = 0").select("row")).distinct(),
                        "stays")
    again = (own.filter("n > 0").groupBy("row").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
             .join(stays, "row").select("row"))
    again, n = materialize(again, "again", count=True)
    rows = docs.withColumn("__row", row_hash())
    out = rows.join(stays.withColumnRenamed("row", "__row").hint("shuffle_hash"), "__row", "left_semi")
    if n:                                    # rows that are there more than once
        twice = again.withColumnRenamed("row", "__row")
        out = out.join(twice, "__row", "left_anti").union(
            rows.join(twice, "__row", "left_semi").dropDuplicates(["__row"]))
    return out.drop("__row")


def families(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: ``id, row, n, fp``; classes of equal sets: ``fp, id, component``)."""
    spark = ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_hash().alias("row"))
    own = materialize(slim.mapInArrow(lean(_signed), "id long, row long, n long, fp binary, bands array<long>"), "signatures")
    classes = materialize(own.filter("n > 0").groupBy("fp").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")

    # classes that share a bucket
    counts = classes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    crowded = spark.sparkContext.broadcast(bitmap(counts.filter("k > 1"), F.col("key"), FILTER_BITS))
    members = materialize(classes.mapInArrow(lean(_in_buckets(crowded)), "key long, fp binary"), "members")
    often = members.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key")
    members = materialize(salted_join(members, often, ["key"], F.col("fp")), "members")    # the bitmap fills up
    named = materialize(classes.join(members.select("fp").distinct(), "fp").select("fp", "id", "n"), "wanted")
    some = spark.sparkContext.broadcast(bitmap(
        named.filter("id IS NOT NULL").select("id").mapInArrow(lean(_ids), "h long"), F.col("h"), FILTER_BITS))

    # their sets, as far as they may have a link
    seen = TwiceSeen(int(named.agg(F.sum("n")).first()[0] or 0), MAX_BITS)
    seen.fill(slim.mapInArrow(lean(_elements(some, seen.bits)), SENT))
    met = spark.sparkContext.broadcast(seen)
    sets = materialize(slim.mapInArrow(lean(_sets(some, met, percent)), "fp binary, n long, c long, elements array<long>")
                       .dropDuplicates(["fp"]), "sets")

    # what buckets connect, and the links in it
    members = materialize(members.join(sets.select("fp"), "fp"), "members")
    middle = (members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("fp").alias("centre"))
              .filter("size > 1").select("key", "centre"))
    members = (salted_join(members, middle, ["key"], F.col("fp")).filter("fp <> centre")
               .select("fp", "centre").distinct())
    label = materialize(components(_family_links(members, sets, percent)), "labels")

    named = classes.select("fp", "id").join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    return own.drop("bands"), materialize(named, "named")


def op4_near_duplicates(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SETS = r"""d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
      FROM d WHERE len(w) > 0)),
z AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM p JOIN z x ON x.r = a JOIN z y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k))"""

OP4_SQL = f"""WITH RECURSIVE {_SETS},
c AS (SELECT r, r AS q FROM d UNION SELECT c.r, l.b FROM c JOIN l ON l.a = c.q)
SELECT any_value(d.doc_id) AS doc_id, CAST(coalesce(any_value(z.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id,
       coalesce(any_value(d.doc_id) = min(o.doc_id), false) AS kept
FROM d JOIN c ON c.r = d.r JOIN d o ON o.r = c.q LEFT JOIN z ON z.r = d.r GROUP BY d.r"""
