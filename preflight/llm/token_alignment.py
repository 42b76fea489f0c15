"""Operator 13 — alignment of two tokenizers over the same texts.

A (byte-level BPE, ``tokenizers``) reads a space and the text, B (pieces with
byte fallback, ``sentencepiece``) the text, to which it adds the space itself.
Places where tokens of both end cut the bytes into groups; every A token of
a group is linked with every B token of it.

Spans: A's character offsets and B's proto spans are the coarse cuts.  Where
they do not tell (a character shared by several A tokens, byte-fallback
pieces with empty spans), the tokens' decoded bytes place the cut; every span
is then held to the decoded bytes.  (Recent sentencepiece calls the immutable
proto ``return_type="proto"``; its spans are bytes.)

A text is cut before each single space between two other characters.  Neither
A's word pattern nor, as its vocabulary shows, a piece of B reaches across
such a place, so a stretch is tokenized and aligned once per worker and
remembered; where a vocabulary does not allow that, a text is one stretch.

Plan: tokens, groups and the distinct id pairs of each document are written
once; Spark counts the documents of every pair.  The pairs in most documents,
at most ``FREQUENT`` of them, go to every task (a fixed size); the links of
all other pairs are joined with their counts.

Cases: null and empty texts, and texts whose joined token bytes differ from
a space and the text (say, with U+2581 inside), have no tokens: zeros and
empty groups.  Repeated rows and rows without an id get a row each, and count
as documents of their own.  A text of any length is read whole.  No documents
give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflight.llm.joins import least_of_frequent
from preflight.llm.ship import ship
from preflight.llm.token_count import byte_symbols, vocabulary
from preflight.session import materialize

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Stretches, and bytes of their rendered groups, that a worker remembers.
MEMO, MEMO_BYTES = 500_000, 96 << 20
#: Pairs sent to every task (16 bytes each).
FREQUENT = 1 << 20
#: Characters of text that are worked on at once (a longer text is a slice of its own).
SLICE = 1 << 20

CUT = re.compile(r"(?<=\S) (?=\S)")
LINKS = "row long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def char_places(text: str) -> np.ndarray:
    """Byte offset of every character, and of the end."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    return np.concatenate([[0], np.cumsum(size)])


def refined(coarse: np.ndarray, sure: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse cut where it is sure, else the last
    sure one before and the decoded bytes since."""
    at = np.maximum.accumulate(np.where(sure, np.arange(len(size)), -1))
    total = np.cumsum(size)
    since = total - np.where(at < 0, 0, total[at])
    return np.where(at < 0, 0, coarse[at]) + since


class Tokenizers:
    """The two tokenizers, their tokens' bytes and spans."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {s: b for b, s in enumerate(byte_symbols())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.number = [str(i) for i in range(max(len(self.a_bytes), self.n_b))]
        self.splits = (self.a.normalizer is None and "ByteLevel" in str(self.a.pre_tokenizer)
                       and not any("▁" in p.lstrip("▁") for p in pieces))

    def stretches(self, text: str) -> list[str]:
        return CUT.split(text) if self.splits else [text]

    def tokens(self, text: str):
        """Ids and byte ends of A's tokens over a space and the text, the same
        of B's over the text; None where their bytes differ from those."""
        whole = " " + text
        raw = whole.encode()
        got = self.a.encode(whole, add_special_tokens=False)
        a = np.array(got.ids, np.int64)
        if b"".join([self.a_bytes[i] for i in got.ids]) != raw:
            return None
        pieces = self.b.encode(text, return_type="proto", num_threads=1).pieces
        ids = [p.id for p in pieces]
        if b"".join([self.b_bytes[i] for i in ids]) != raw:
            return None
        b = np.array(ids, np.int64)
        span = np.array(got.offsets, np.int64).reshape(-1, 2)
        place = np.arange(len(raw) + 1) if len(raw) == len(whole) else char_places(whole)
        sure = np.ones(len(a), bool)
        sure[:-1] = span[1:, 0] >= span[:-1, 1]             # no character shared with the next token
        a_ends = refined(place[span[:, 1]], sure, self.a_size[a])
        end = np.array([p.end for p in pieces], np.int64)
        # an empty span: a byte of a character, or the space that B adds
        b_ends = refined(end + 1, np.diff(end, prepend=0) > 0, self.b_size[b])
        # every span is held to the decoded bytes
        return tuple(x for ids, ends, size in ((a, a_ends, self.a_size), (b, b_ends, self.b_size))
                     for x in (ids, ends if (ends == np.cumsum(size[ids])).all() else np.cumsum(size[ids])))


#: Stretches that are tokenized as one text.
TOGETHER = 1000
#: Links of a group that are listed one by one; of larger ones, equal pairs at once.
LISTED = 4096


class Aligned:
    """What a worker remembers of stretches: row k of each array is stretch k."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.clear()

    def clear(self) -> None:
        self.memo, self.text, self.size, self.new = {}, [], 0, []
        self.facts = np.zeros((0, 7), np.int64)       # a, b, groups, links, bad, first pair, pairs
        self.uses = np.zeros(0, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep the stretches met again, if they are not most of them."""
        keep = np.flatnonzero(self.uses > 1)
        size = sum(len(self.text[k]) for k in keep.tolist())
        if 2 * len(keep) > MEMO or 2 * size > MEMO_BYTES:
            return self.clear()
        old, back = list(self.memo), keep.tolist()
        self.memo = {old[k]: i for i, k in enumerate(back)}
        self.text, self.size = [self.text[k] for k in back], size
        first, count = self.facts[keep, 5], self.facts[keep, 6]
        start = np.cumsum(count) - count
        at = np.arange(count.sum()) + np.repeat(first - start, count)
        self.pairs, self.times = self.pairs[at], self.times[at]
        self.facts, self.uses = self.facts[keep], np.zeros(len(keep), np.int64)
        self.facts[:, 5] = start

    def add(self, parts: list[str]) -> None:
        """Tokenize new stretches, as one text; where its bytes differ, halves of it."""
        if not parts:
            return
        got = self.t.tokens(" ".join(parts))
        stops = np.cumsum([len(p.encode()) + 1 for p in parts])
        common = np.intersect1d(got[1], got[3]) if got else None
        if got is None or not np.isin(stops, common).all():
            if len(parts) > 1:
                self.add(parts[:len(parts) // 2])
                self.add(parts[len(parts) // 2:])
            else:
                self._keep(parts, np.array([[0, 0, 0, 0, 1, 0, 0]]), [""], self.pairs[:0], self.times[:0])
            return
        a, a_ends, b, b_ends = got
        group = [np.searchsorted(common, x) for x in (a_ends, b_ends)]
        n_a, n_b = (np.bincount(g, minlength=len(common)) for g in group)
        x, y = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        number = self.t.number
        sa, sb = [number[i] for i in a.tolist()], [number[i] for i in b.tolist()]
        text = [sa[i] + "|" + sb[j] if p == 1 == q else ",".join(sa[i:i + p]) + "|" + ",".join(sb[j:j + q])
                for i, j, p, q in zip(x.tolist(), y.tolist(), n_a.tolist(), n_b.tolist())]
        links = n_a * n_b
        listed = np.where(links <= LISTED, links, 0)
        # the k-th link of a group joins its A token k // n_b with its B token k % n_b
        g = np.repeat(np.arange(len(common)), listed)
        k = np.arange(len(g)) - (np.cumsum(listed) - listed)[g]
        pairs, times = a[x[g] + k // n_b[g]] * self.t.n_b + b[y[g] + k % n_b[g]], np.ones(len(g), np.int64)
        for i in np.flatnonzero(links > LISTED).tolist():
            (ua, ca), (ub, cb) = (np.unique(ids[s:s + n], return_counts=True)
                                  for ids, s, n in ((a, x[i], n_a[i]), (b, y[i], n_b[i])))
            at = np.searchsorted(g, i)
            g = np.insert(g, at, np.full(len(ua) * len(ub), i))
            pairs = np.insert(pairs, at, (ua[:, None] * self.t.n_b + ub).ravel())
            times = np.insert(times, at, (ca[:, None] * cb).ravel())
        last = np.searchsorted(common, stops) + 1              # groups up to the end of each stretch
        first = np.concatenate([[0], last[:-1]])
        total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[last], prepend=0)
        rows = np.searchsorted(g, last)
        facts = np.stack([total(n_a), total(n_b), last - first, total(links), np.zeros(len(parts), np.int64),
                          np.concatenate([[0], rows[:-1]]), np.diff(rows, prepend=0)], axis=1)
        self._keep(parts, facts, [";".join(text[i:j]) for i, j in zip(first.tolist(), last.tolist())], pairs, times)

    def _keep(self, parts, facts, text, pairs, times) -> None:
        facts[:, 5] += len(self.pairs) + sum(len(x[1]) for x in self.new)
        n = len(self.text)
        self.memo.update(zip(parts, range(n, n + len(parts))))
        self.text += text
        self.size += sum(map(len, text)) + sum(map(len, parts))
        self.new.append((facts, pairs, times))

    def learn(self, parts: list[str]) -> None:
        """Remember new stretches."""
        self.new = []
        for lo in range(0, len(parts), TOGETHER):
            self.add(parts[lo:lo + TOGETHER])
        if self.new:
            facts, pairs, times = zip(*self.new)
            self.facts = np.concatenate([self.facts, *facts])
            self.uses = np.concatenate([self.uses, np.zeros(len(self.facts) - len(self.uses), np.int64)])
            self.pairs, self.times = np.concatenate([self.pairs, *pairs]), np.concatenate([self.times, *times])
            self.new = []

    def documents(self, texts: list[str | None], digest: bool):
        """Columns of ``LINKS`` from ``n_a`` on, for some texts."""
        if len(self.memo) > MEMO or self.size > MEMO_BYTES:
            self.forget()
        split = [self.t.stretches(t) if t else [] for t in texts]
        flat = [p for parts in split for p in parts]
        self.learn([p for p in dict.fromkeys(flat) if p not in self.memo])
        n = len(texts)
        ids = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat))
        self.uses += np.bincount(ids, minlength=len(self.uses))
        stops = np.cumsum([len(p) for p in split], dtype=np.int64)
        doc = np.repeat(np.arange(n), np.diff(stops, prepend=0))
        facts = self.facts[ids]
        bad = np.bincount(doc, facts[:, 4], n) > 0
        sums = [np.where(bad, 0, np.bincount(doc, facts[:, c], n).astype(np.int64)) for c in range(4)]
        groups, lo = [], 0
        for hi, wrong in zip(stops.tolist(), bad):
            s = "" if wrong else ";".join([self.text[i] for i in ids[lo:hi].tolist()])
            groups.append(hashlib.sha256(s.encode()).hexdigest() if digest and s else s)
            lo = hi
        count = np.where(bad[doc], 0, facts[:, 6])
        first = np.cumsum(count) - count
        at = np.arange(count.sum()) + np.repeat(facts[:, 5] - first, count)
        times, all_pairs = self.times[at], len(self.t.a_bytes) * self.t.n_b
        key = np.repeat(doc, count) * all_pairs + self.pairs[at]      # document and pair
        if (times == 1).all():
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        total = np.add.reduceat(times, start) if len(start) else times
        owner, pair = np.divmod(key[start], all_pairs)
        off = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(v)) for v in (pair, total)]
        return [*(pa.array(s, pa.int64()) for s in sums), pa.array(groups, pa.string()), *lists]


@lru_cache(maxsize=1)
def aligned(a_path: str, b_path: str) -> Aligned:
    return Aligned(Tokenizers(a_path, b_path))


def _align(a_path, b_path, digest):
    def run(batches):
        gc.disable()         # nothing here is cyclic, and what is remembered is long to look through
        worker = aligned(a_path or vocabulary(A_NAME), b_path or vocabulary(B_NAME))
        for b in batches:
            texts = b.column(2).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= SLICE):
                    size += len(texts[hi] or "")
                    hi += 1
                cols = [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *worker.documents(texts[lo:hi], digest)]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links",
                                                              "groups", "pairs", "times"])
                lo = hi
        gc.enable()
    return run


def linked(df: DataFrame, a_path: str | None = None, b_path: str | None = None, digest: bool = False) -> DataFrame:
    """Per document its tokens' numbers, groups (``a1,a2|b1;a3|b2``) and the
    distinct id pairs (A id * size of B + B id) with their links."""
    ship(df.sparkSession)
    kind = df.schema["doc_id"].dataType.simpleString()
    slim = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return slim.mapInArrow(_align(a_path, b_path, digest), LINKS.format(kind))


def pair_counts(links: DataFrame, n_b: int) -> DataFrame:
    """``(pair, n, best)``: the documents that hold the pair, and whether that
    is the most of its A id.  The most of each A id is one row per entry of
    A's vocabulary."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "align-pairs")
    own = (F.col("pair") / F.lit(n_b)).cast("long")
    most = counts.groupBy(own.alias("a")).agg(F.max("n").alias("most"))
    return (counts.withColumn("a", own).join(F.broadcast(most), "a")
            .select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _scored(shared):
    def run(batches):
        known, n, best = shared.value
        for b in batches:
            pairs, times = b.column(b.schema.get_field_index("pairs")), b.column(b.schema.get_field_index("times"))
            off = pairs.offsets.to_numpy().astype(np.int64)
            p = pairs.values.to_numpy()[off[0]:off[-1]]
            t = times.values.to_numpy()[times.offsets[0].as_py():times.offsets[-1].as_py()]
            off = off - off[0]
            at = np.searchsorted(known, p)
            at[at == len(known)] = 0
            has = known[at] == p if len(known) else np.zeros(len(p), bool)

            def total(v):
                s = np.zeros(len(p) + 1, np.int64)
                np.cumsum(v, out=s[1:])
                return pa.array(s[off[1:]] - s[off[:-1]])

            of = np.where(has, at, 0)
            sums = [total(np.where(has, t * x[of], 0) if len(known) else np.zeros(len(p), np.int64)) for x in (n, best)]
            left = np.zeros(len(p) + 1, np.int64)
            np.cumsum(~has, out=left[1:])
            rest = [pa.ListArray.from_arrays(pa.array(left[off].astype(np.int32)), pa.array(v[~has])) for v in (p, t)]
            keep = [i for i, f in enumerate(b.schema) if f.name not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + sums + rest,
                                             names=[b.schema.field(i).name for i in keep] +
                                             ["count_sum", "n_best", "rest", "rest_times"])
    return run


def align(df: DataFrame, a_path: str | None = None, b_path: str | None = None, digest: bool = False,
          limit: int | None = None) -> DataFrame:
    """One row per document (``doc_id``, ``text``): ``n_a``, ``n_b``,
    ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups``
    (``digest``: ``groups_sha256``, lowercase hex of it, '' without tokens).

    ``a_path``, ``b_path``: tokenizer files that every executor sees; without
    them each executor uses its own copy of the public files.  ``limit``:
    pairs sent to every task (``FREQUENT``)."""
    spark = df.sparkSession
    import sentencepiece
    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path or vocabulary(B_NAME)).get_piece_size()
    links = materialize(linked(df, a_path, b_path, digest), "align-links")
    counts = materialize(pair_counts(links, n_b), "align-counts")
    least = least_of_frequent(counts, FREQUENT if limit is None else limit)
    top = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast((top["pair"].to_numpy(), top["n"].to_numpy(),
                                           top["best"].to_numpy().astype(np.int64)))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in links.schema if f.name not in ("pairs", "times")]
    out = links.mapInArrow(_scored(shared), ", ".join([*fields, "count_sum long", "n_best long", "rest array<long>",
                                                       "rest_times array<long>"]))
    if least > 0:
        out = materialize(out, "align-scored")
        each = (out.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x"))
                .select("row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("t")))
        more = (each.join(counts.filter(F.col("n") < least), "pair").groupBy("row")
                .agg(F.sum(F.col("t") * F.col("n")).alias("more"),
                     F.sum(F.when(F.col("best"), F.col("t")).otherwise(F.lit(0))).alias("more_best")))
        out = (out.join(more, "row", "left")
               .withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
               .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      F.col("groups").alias("groups_sha256" if digest else "groups"))


def op13_token_alignment(spark, sf_dir):
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
