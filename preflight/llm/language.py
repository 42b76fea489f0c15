"""Operator 2 — language identification of mixed-language text.

A word is a run of letters a-z (A-Z lowered) and non-ASCII characters.
The script of its characters (by UTF-8 lead bytes) narrows the languages:
a language is a candidate for a script if at least 1 % of its training
words are written in it; a word in a script of no language speaks for
none.  A candidate's score of a word is the sum of its log-likelihoods of
the word's byte trigrams (with word edges) and of the whole word, relative
to their mean over languages, cut at ``CUT`` below the best.  Viterbi over the words
of a text, with ``SWITCH`` for a change of language, labels spans.  All texts
of a slice take their steps together, so the loop runs over the words of
the longest one.

The model is counted from labelled texts by Spark; ``train_docs`` bounds
the expected number of texts (a hash of id and text chooses them), to which
each language adds at most ``LEAST_DOCS``, so that a rare one stays.  Its size
depends on the number of languages only.

The prediction is the language with most bytes of words.  The score is its
share of those bytes times the softmax of the summed scores of its words.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text if there is no labelled one.  Ties go to the first language in
order.  A null doc_id is never learned from and not held out.  Repeated
rows get equal rows; a text of any length is labelled whole; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflight.llm.arrow_text import ASCII_LOWER, RangeHash, Texts, lean, mask, runs, text_slices
from preflight.llm.ship import ship

TRAIN_DOCS = 40_000
LEAST_DOCS = 1_000       # of a language, as far as it has them
SLICE = 1 << 20
SWITCH, CUT = 14.0, 12.0
BUCKETS_LOG2 = 16
BUCKETS = 1 << BUCKETS_LOG2
FEATURES = 2 * BUCKETS
SCRIPTS = 128
ALPHA = 0.3
LETTER = mask(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)

# Script classes by lead byte: 0 none (digits, signs), 1 Latin, 2 Greek,
# 3 Cyrillic, 4 Armenian, 5 Hebrew, 6 Arabic, 7 Syriac to N'Ko, 8 Han,
# 9 kana, 10 Hangul; three-byte scripts of Asia and Africa by second byte.
_LEAD = np.zeros(256, np.uint8)
_LEAD[0x61:0x7B] = 1
_LEAD[0xC3:0xCB] = 1
_LEAD[0xCE:0xD0] = 2
_LEAD[0xD0:0xD4] = 3
_LEAD[0xD4:0xD6] = 4
_LEAD[0xD6:0xD8] = 5
_LEAD[0xD8:0xDC] = 6
_LEAD[0xDC:0xE0] = 7
_LEAD[0xE4:0xEA] = 8
_LEAD[0xEA:0xEE] = 10


def scripts(data: np.ndarray) -> np.ndarray:
    """Script class of each lead byte; 0 for other bytes."""
    out = _LEAD[data]
    at = np.flatnonzero((data == 0xE0) | (data == 0xE1) | (data == 0xE3))
    if len(at):
        nxt = data[np.minimum(at + 1, len(data) - 1)].astype(np.int64)
        out[at] = np.select(
            [data[at] == 0xE0, data[at] == 0xE3, (nxt >= 0xB8) & (nxt <= 0xBB), nxt >= 0xBC],
            [16 + ((nxt - 0xA0) >> 1), np.where((nxt >= 0x81) & (nxt <= 0x83), 9, 8), 1, 2],
            64 + ((nxt - 0x80) >> 1))
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in lower case."""
    low = ASCII_LOWER[data]
    big = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1 \
        if len(low) else np.zeros(0, np.int64)
    low[big] += 0x20
    return low


class Words:
    """Words of a slice with their features: ``gram`` for every byte
    (FEATURES outside words), ``whole`` and ``script`` for every word."""

    def __init__(self, t: Texts):
        data = lowered(t.data)
        self.starts, self.ends, self.counts = runs(Texts(data, t.starts, t.ends, t.rows), LETTER)
        inside = LETTER[data]
        ahead, after = np.zeros(len(data), np.uint32), np.zeros(len(data), np.uint32)
        ahead[1:], after[:-1] = data[:-1], data[1:]
        ahead[self.starts] = 0
        after[self.ends - 1] = 0
        tri = (ahead << np.uint32(16)) | (data.astype(np.uint32) << np.uint32(8)) | after
        gram = (tri * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS_LOG2)
        self.gram = np.where(inside, gram, np.uint32(FEATURES)).astype(np.int32)
        h = RangeHash(data)(self.starts, self.ends)
        self.whole = (BUCKETS + (h >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64))
        cls = np.where(inside, scripts(data), 0)
        self.script = np.maximum.reduceat(cls, self.starts) if len(self.starts) else np.zeros(0, np.uint8)
        self.bytes = self.ends - self.starts


def _counts(batches):
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(b.schema.get_field_index("lang")).to_pylist()
        for t in text_slices(b):
            w = Words(t)
            own = np.array([langs[r] for r in t.rows], object)
            word_doc = np.repeat(np.arange(len(t)), w.counts)
            byte_doc = np.repeat(np.arange(len(t)), t.ends - t.starts)
            for lang in set(own):
                of = own == lang
                n = total.setdefault(lang, np.zeros(FEATURES + 1 + SCRIPTS, np.int64))
                n[:FEATURES + 1] += np.bincount(w.gram[of[byte_doc]], minlength=FEATURES + 1)
                words = of[word_doc]
                n[:FEATURES] += np.bincount(w.whole[words], minlength=FEATURES)[:FEATURES]
                n[FEATURES + 1:] += np.bincount(w.script[words], minlength=SCRIPTS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        at = at[at != FEATURES]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])],
            names=["lang", "feature", "n"])


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, writes: np.ndarray):
        self.langs, self.weights, self.writes = langs, weights, writes   # [feature, lang], [script, lang]


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Model from texts with a non-null ``lang`` (columns doc_id, text,
    lang).  The counts that come to the driver are one row for each language
    and feature bucket at most."""
    ship(labelled.sparkSession)
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    held = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("held"))
    n = held.agg(F.sum("held")).first()[0] or 0
    if n > train_docs:
        # one row per language; of 2^30 parts, how many are chosen
        share = held.select("lang", F.greatest(F.lit(train_docs / n), F.lit(LEAST_DOCS) / F.col("held")).alias("share"))
        rows = rows.join(F.broadcast(share), "lang").filter(
            F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("share") * F.lit(1 << 30))
    got = (rows.select("lang", "text").mapInArrow(lean(_counts), "lang string, feature int, n long")
           .groupBy("lang", "feature").agg(F.sum("n").alias("n")).orderBy("lang").toArrow())
    lang, feature, count = (got[c].to_numpy() for c in ("lang", "feature", "n"))
    langs = sorted(set(lang))
    start = [*np.searchsorted(lang, np.array(langs, object)), len(lang)] if langs else [0]
    used = np.zeros((len(langs), SCRIPTS))
    logp, seen = np.empty((len(langs), FEATURES), np.float64), np.zeros(FEATURES, bool)
    for j in range(len(langs)):
        own = np.zeros(FEATURES + 1 + SCRIPTS)
        own[feature[start[j]:start[j + 1]]] = count[start[j]:start[j + 1]]
        used[j], grams = own[FEATURES + 1:], own[:FEATURES] + ALPHA
        seen |= own[:FEATURES] > 0
        logp[j] = np.log(grams)
        for part in (slice(0, BUCKETS), slice(BUCKETS, FEATURES)):
            logp[j, part] -= np.log(grams[part].sum())
    weights = np.zeros((FEATURES + 1, len(langs)), np.float32)
    if langs:
        mean = logp.mean(0)
        for j in range(len(langs)):
            weights[:FEATURES, j] = np.where(seen, logp[j] - mean, 0)
    writes = (used >= 0.01 * np.maximum(used.sum(1, keepdims=True), 1)).T & (used.T > 0)
    return Model(langs, weights, writes)


def word_scores(w: Words, m: Model) -> np.ndarray:
    """[word, language] scores, at most 0 for the best and cut below."""
    n, k = len(w.starts), len(m.langs)
    e = np.empty((n, k), np.float32)
    for j in range(k):
        e[:, j] = np.add.reduceat(m.weights[:, j][w.gram], w.starts) if n else 0
        e[:, j] += m.weights[:, j][w.whole]
    may = m.writes[w.script]
    any_ = may.any(1)
    e = np.where(may, e, -np.inf)
    e[~any_] = 0
    e -= e.max(1, keepdims=True)
    return np.maximum(e, -CUT, out=e)


def viterbi(e: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word; ``counts`` words belong to each text."""
    n, k = len(counts), e.shape[1]
    kind = np.min_scalar_type(-max(k, 1))        # holds every label
    label = np.zeros(len(e), kind)
    order = np.argsort(-counts, kind="stable")
    size = counts[order]
    first = (np.cumsum(counts) - counts)[order]
    steps = int(size[0]) if n else 0
    live = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")     # texts with over t words
    v = np.zeros((n, k), np.float32)
    back = []
    own = np.arange(k, dtype=kind)[None, :]
    for t in range(steps):
        a = live[t]
        best = v[:a].argmax(1)
        jump = v[np.arange(a), best] - switch
        stay = v[:a] >= jump[:, None]
        back.append(np.where(stay, own, best.astype(kind)[:, None]))
        v[:a] = np.where(stay, v[:a], jump[:, None]) + e[first[:a] + t]
    state = np.zeros(n, np.int64)
    done = 0
    for t in range(steps - 1, -1, -1):
        a = live[t]
        if a > done:
            state[done:a] = v[done:a].argmax(1)
            done = a
        label[first[:a] + t] = state[:a]
        state[:a] = back[t][np.arange(a), state[:a]]
    return label


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode())


def _predict(shared, spans: bool, text: bool):
    def run(batches):
        m = shared.value
        k = len(m.langs)
        for b in batches:
            keep = [i for i, f in enumerate(b.schema) if text or f.name != "text"]
            for t in text_slices(b, limit=SLICE):
                n = len(t)
                lang, score, found = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
                if k and len(t.data):
                    w = Words(t)
                    e = word_scores(w, m)
                    label = viterbi(e, w.counts).astype(np.int64)
                    doc = np.repeat(np.arange(n), w.counts)
                    share = np.bincount(doc * k + label, weights=w.bytes, minlength=n * k).reshape(n, k)
                    best = share.argmax(1)
                    own = label == best[doc]           # words that the prediction rests on
                    total = np.stack([np.bincount(doc[own], weights=e[own, j], minlength=n) for j in range(k)], 1)
                    total = np.exp(total - total.max(1, keepdims=True))
                    total /= total.sum(1, keepdims=True)
                    mass = share.sum(1)
                    ascii_ = np.concatenate([[0], np.cumsum(LETTER[t.data | 0x20] & (t.data < 0x80))])
                    plain = ascii_[t.ends] - ascii_[t.starts] > 0
                    for i in np.flatnonzero(mass > 0):
                        if plain[i] or _has_letter(t.raw(i)):
                            j = best[i]
                            lang[i] = m.langs[j]
                            score[i] = share[i, j] / mass[i] * total[i, j]
                    if spans and len(label):
                        cut = np.flatnonzero((np.diff(label) != 0) | (np.diff(doc) != 0))
                        x, y = np.r_[0, cut + 1], np.r_[cut, len(label) - 1]
                        for p, q in zip(x, y):
                            d = doc[p]
                            if lang[d] != "und":
                                found[d].append({"lo": int(w.starts[p] - t.starts[d]),
                                                 "hi": int(w.ends[q] - t.starts[d]), "lang": m.langs[label[p]]})
                cols = [b.column(i).slice(t.rows.start, n) for i in keep]
                names = [b.schema.field(i).name for i in keep]
                cols += [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                names += ["lang_pred", "score"]
                if spans:
                    cols.append(pa.array(found, pa.list_(pa.struct(
                        [("lo", pa.int32()), ("hi", pa.int32()), ("lang", pa.string())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def identify(docs: DataFrame, model: Model, spans: bool = False, text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are
    replaced); with ``spans`` also the labelled byte ranges ``lo, hi, lang``,
    with ``text`` also the text."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", *["spans"] * spans)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if text or f.name != "text"]
    fields += ["lang_pred string", "score double"]
    if spans:
        fields.append("spans array<struct<lo:int,hi:int,lang:string>>")
    return docs.mapInArrow(lean(_predict(shared, spans, text)), ", ".join(fields))


def held_out():
    """Rows that no model may learn from: crc32 of the id mod 4 is 2."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op2_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    slim = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return identify(slim, model)
