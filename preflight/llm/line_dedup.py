"""Operator 3 — line deduplication with two Bloom filters.

Pass 1 hashes every line of every text inside Arrow batches and merges the
tasks' filter places into a *once-seen* and a *twice-seen* filter
(``filters.TwiceSeen``).  A key held by two texts is in the second one for
certain.  Pass 2 reads the texts again and shuffles only
lines that the twice-seen filter lets through, as 128-bit digests with the
document's id; a plain count confirms them and finds the largest id.

The filters have 8 bits a line up to ``max_bits`` (2^28: 32 MB, the bound
of what the tasks are sent).  Beyond that size more single lines reach the
exact count; the result is the same.

A line's key is the line without ASCII white space at both ends and with
A-Z lowered.  Keys of at least ``min_chars`` code points held by at least
``min_docs`` distinct doc_ids lose all their lines, except in the largest
doc_id that holds them (there all of them stay).

Cases: a null or empty text is one empty line (as an operator result an
empty text); rows of one doc_id are one document; a null doc_id holds
nothing, but loses the lines that others share often enough (such rows are
told apart by a hash of their text); repeated rows are judged alike; a text of
any length is split whole; an empty table gives an empty result; other columns
pass through (names that begin with ``__`` are reserved).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflight.llm.arrow_text import ASCII_LOWER, SPACE, RangeHash, Texts, lean, text_slices
from preflight.llm.filters import PLACES, TwiceSeen, places_of_task
from preflight.llm.joins import salted_join
from preflight.llm.ship import ship
from preflight.session import materialize

MIN_CHARS, MIN_DOCS = 20, 3
MAX_BITS = 28
STRIP = b" \t\n\x0b\x0c\r"


def line_keys(t: Texts, min_chars: int):
    """Eligible lines of a slice, once per text: text index, key start, key
    end, 64-bit hash."""
    data = ASCII_LOWER[t.data]
    at = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([t.starts, at + 1]))
    ends = np.sort(np.concatenate([t.ends, at]))
    text = np.repeat(np.arange(len(t)), np.searchsorted(at, t.ends) - np.searchsorted(at, t.starts) + 1)
    solid = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    some = a <= b
    s, e, text = solid[a[some]], solid[b[some]] + 1, text[some]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    big = chars[e] - chars[s] >= min_chars
    s, e, text = s[big], e[big], text[big]
    h = RangeHash(data)(s, e)
    order = np.lexsort((h, text))
    s, e, text, h = s[order], e[order], text[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return data, text[first], s[first], e[first], h[first]


def _once_and_twice(bits_log2: int, min_chars: int):
    def run(batches):
        yield from places_of_task((line_keys(t, min_chars)[4] for b in batches for t in text_slices(b)), bits_log2)
    return run


def twice_seen(docs: DataFrame, min_chars: int = MIN_CHARS, max_bits: int = MAX_BITS) -> TwiceSeen:
    """The twice-seen filter of all lines."""
    lines = docs.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n")))
                           + F.lit(1))).first()[0] or 1
    seen = TwiceSeen(int(lines), max_bits)
    return seen.fill(docs.select("text").mapInArrow(lean(_once_and_twice(seen.bits, min_chars)), PLACES))


def _null_row(doc_id, text):
    """What tells rows without an id apart; null for the others."""
    return F.when(F.col(doc_id).cast("long").isNull(), F.xxhash64(F.coalesce(text, F.lit(""))))


def _suspects(shared, min_chars: int):
    """Lines that the twice-seen filter lets through: 128-bit key, id and
    null row."""
    def run(batches):
        seen = shared.value
        for b in batches:
            ids, null_rows = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "null_row"))
            for t in text_slices(b):
                data, text, s, e, h = line_keys(t, min_chars)
                k = np.flatnonzero(seen.has(h))
                keys = [xxhash.xxh3_128_digest(data[x:y].tobytes()) for x, y in zip(s[k], e[k])]
                at = pa.array(text[k] + t.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), ids.take(at).cast(pa.int64()), null_rows.take(at)],
                    names=["key", "doc_id", "null_row"])
    return run


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, null_row, keys`` — the 128-bit keys of the lines each document
    loses; rows without an id by their text."""
    spark = ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(twice_seen(slim, min_chars))       # 32 MB at most
    named = slim.withColumn("null_row", _null_row("doc_id", "text"))
    held = materialize(named.mapInArrow(lean(_suspects(shared, min_chars)), "key binary, doc_id long, null_row long")
                       .distinct(), "lines")
    often = (held.groupBy("key").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
             .filter(F.col("n") >= min_docs).select("key", "keeper"))
    return (salted_join(held, often, ["key"], F.coalesce("doc_id", "null_row"))
            .filter(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("keeper")))
            .groupBy("doc_id", "null_row").agg(F.collect_list("key").alias("keys")))


def _lose(raw: bytes, gone: set) -> tuple[bytes, int, int]:
    lines = raw.split(b"\n")
    keep = [x for x in lines if xxhash.xxh3_128_digest(x.strip(STRIP).lower()) not in gone]
    return b"\n".join(keep), len(lines), len(lines) - len(keep)


def _rewrite(digest: bool):
    """Drop each text's lost lines; either the text comes back or its digest."""
    def run(batches):
        for b in batches:
            keys = b.column(b.schema.get_field_index("__lost"))
            n_lines, n_dropped, kept = [], [], []
            for t in text_slices(b):
                lost = keys.slice(t.rows.start, len(t)).to_pylist()
                for i, gone in enumerate(lost):
                    raw = t.raw(i)
                    text, n, k = _lose(raw, set(gone)) if gone else (raw, raw.count(b"\n") + 1, 0)
                    n_lines.append(n)
                    n_dropped.append(k)
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            cols = {f.name: b.column(i) for i, f in enumerate(b.schema) if f.name not in ("__lost", "text")}
            cols |= {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()),
                     "kept_sha256" if digest else "text": pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)
    return run


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               digest: bool = False) -> DataFrame:
    """Documents without their lost lines, with ``n_lines`` (before) and
    ``n_dropped``; with ``digest``, only doc_id, the two counts and the
    SHA-256 of the remaining text."""
    lost = repeated_lines(docs, min_chars, min_docs)
    src = docs.select("doc_id", "text") if digest else docs.drop("n_lines", "n_dropped")
    d, k = src.alias("d"), lost.hint("shuffle_hash").alias("k")
    same = (F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id"))
            & _null_row("d.doc_id", "d.text").eqNullSafe(F.col("k.null_row")))
    both = d.join(k, same, "left").select("d.*", F.col("k.keys").alias("__lost"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text"]
    fields += ["n_lines long", "n_dropped long", "kept_sha256 string" if digest else "text string"]
    return both.mapInArrow(lean(_rewrite(digest)), ", ".join(fields))


def op3_line_dedup(spark, sf_dir):
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


OP3_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, i, l[i] AS line, translate(trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
g AS (SELECT k, max(doc_id) AS keeper FROM x WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
y AS (SELECT x.*, g.k IS NOT NULL AND x.doc_id IS DISTINCT FROM g.keeper AS gone FROM x LEFT JOIN g ON x.k = g.k)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM y GROUP BY r"""
