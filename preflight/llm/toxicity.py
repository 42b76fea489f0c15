"""Operator 5 — toxicity by cumulative-link ordinal regression.

Severity grades 0 to 3: P(grade >= k) = sigmoid(w . x - t_k), one weight
vector for all thresholds t_1 < t_2 < t_3.  A text's expected severity is the
sum of the three probabilities; it is toxic if P(grade >= 1) is 0.5 or more.

Features are words (runs of letters, lower case) and their first 5 to 8
bytes, hashed to 2^20 buckets, as log(1 + count).  Kept are
buckets that speak for toxicity more often than not: the lower bound
(Wilson, z = 3.29) of the share of toxic texts among the distinct texts that
hold them is at least one half; ``MAX_FEATURES`` at most, by that bound.

Labels say toxic or not; grades 1 to 3 of toxic texts are the terciles of
their summed features (1, if they have none).

Everything counted comes from Spark aggregations over the labelled sample;
``train_docs`` bounds its expected size (chosen by hash of the id).  What the
driver fits is the sample's rows in the kept buckets.

Cases: null and wordless texts have severity and score of no words; without
labels of both kinds all severities are 0; ids with several labels count
as toxic if one says so; repeated rows get equal rows; texts are read whole;
an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflight.llm.arrow_text import RangeHash, Texts, mix, runs, text_slices
from preflight.llm.language import LETTER, lowered
from preflight.llm.ship import ship
from preflight.session import materialize

TRAIN_DOCS = 20_000
BUCKETS_LOG2 = 20
MAX_FEATURES = 1024
#: Bytes of a word's beginning that are features of their own (inflected and compound words).
PREFIXES = (5, 6, 7, 8)
Z = 3.29
GRADES = 4


def word_counts(t: Texts, kept: np.ndarray | None = None):
    """(text, bucket, count) triples of a slice, and words of each text;
    ``kept``: sorted buckets to look at."""
    data = lowered(t.data)
    s, e, n = runs(Texts(data, t.starts, t.ends, t.rows), LETTER)
    hashes = RangeHash(data)
    text = np.repeat(np.arange(len(t)), n)
    features, texts = [hashes(s, e)], [text]
    for size in PREFIXES:
        long = e - s > size
        features.append(mix(hashes(s[long], s[long] + size) + np.uint64(size)))
        texts.append(text[long])
    bucket = (np.concatenate(features) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
    text = np.concatenate(texts)
    if kept is not None:
        i = np.minimum(np.searchsorted(kept, bucket), max(len(kept) - 1, 0))
        ok = kept[i] == bucket if len(kept) else np.zeros(len(bucket), bool)
        text, bucket = text[ok], bucket[ok]
    key, count = np.unique((text << BUCKETS_LOG2) | bucket, return_counts=True)
    return key >> BUCKETS_LOG2, key & ((1 << BUCKETS_LOG2) - 1), count, n


def _features(kept: np.ndarray | None):
    def run(batches):
        for b in batches:
            for t in text_slices(b):
                text, bucket, count, n = word_counts(t, kept)
                per = np.bincount(text, minlength=len(t))
                off = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index("toxic")).slice(t.rows.start, len(t)),
                     pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(off, pa.array(bucket.astype(np.int32))),
                     pa.ListArray.from_arrays(off, pa.array(count.astype(np.int32)))],
                    names=["toxic", "n_words", "bucket", "count"])
    return run


ROWS = "toxic int, n_words int, bucket array<int>, count array<int>"


class Model:
    """Kept buckets (sorted), their weights, thresholds."""

    def __init__(self, buckets, weights, thresholds):
        self.buckets, self.weights, self.thresholds = buckets, weights, thresholds

    def probabilities(self, text, bucket, count, n_words) -> np.ndarray:
        """P(grade >= k), k = 1..3, of every text."""
        s = np.zeros(len(n_words))
        if len(self.buckets):
            i = np.searchsorted(self.buckets, bucket)
            s = s + np.bincount(text, weights=self.weights[i] * np.log1p(count), minlength=len(n_words))
        return 1 / (1 + np.exp(-(s[:, None] - self.thresholds[None, :])))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, l2: float = 1e-5, steps: int = 600, rate: float = 0.1):
    """Weights and ascending thresholds of the cumulative-link model, by
    Adam on the penalised likelihood (thresholds: first value and logs of the
    gaps).  Rows without features differ in their grade only and are taken
    together."""
    n, d = x.shape
    some = x.any(1)
    empty = np.bincount(grade[~some], minlength=GRADES)
    many = np.concatenate([np.ones(some.sum()), empty])
    x = np.concatenate([x[some], np.zeros((GRADES, d), x.dtype)])
    grade = np.concatenate([grade[some], np.arange(GRADES)])
    k = GRADES - 1
    p = np.ones(d + k)
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        t = p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1:]))])
        z = x @ p[:d]
        r = np.arange(len(x))
        above = np.concatenate([np.ones((len(x), 1)), sig(z[:, None] - t), np.zeros((len(x), 1))], 1)
        like = np.maximum(above[r, grade] - above[r, grade + 1], 1e-12)
        slope = above * (1 - above)
        dz = many * (slope[r, grade] - slope[r, grade + 1]) / like
        g = np.zeros_like(p)
        g[:d] = -(x.T @ dz) / n + l2 * p[:d]
        dt = np.zeros(k)
        for j in range(k):
            hi, lo = grade == j + 1, grade == j
            each = many * slope[:, j + 1] / like
            dt[j] = each[hi].sum() - each[lo].sum()
        g[d] = dt.sum() / n
        for j in range(1, k):
            g[d + j] = dt[j:].sum() * np.exp(p[d + j]) / n
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return p[:d], p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1:]))])


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Model from ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic 0/1)."""
    ship(docs.sparkSession)
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES - 1, 40.0))
    own = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    n = own.count()
    if n > train_docs:
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(train_docs / n * (1 << 30)))
    # a bounded sample of ids: two numbers for each of about train_docs rows
    texts = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("toxic", "text")
    rows = materialize(texts.mapInArrow(_features(None), ROWS), "labelled")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return nothing
    has = (rows.dropDuplicates(["bucket", "count"]).select("toxic", F.explode("bucket").alias("bucket"))
           .groupBy("bucket").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")))
    n, p = F.col("n"), F.col("bad") / F.col("n")
    least = (p + Z * Z / (2 * n) - Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    best = (has.withColumn("least", least).filter("least >= 0.5").orderBy(F.desc("least"), "bucket")
            .limit(MAX_FEATURES).select("bucket").toArrow())
    kept = np.sort(best["bucket"].to_numpy()).astype(np.int64)
    got = texts.mapInArrow(_features(kept), ROWS).toArrow().to_pylist()
    x, toxic, evidence = np.zeros((len(got), len(kept)), np.float32), np.zeros(len(got), np.int64), np.zeros(len(got))
    for i, r in enumerate(got):
        at = np.searchsorted(kept, r["bucket"])
        x[i, at] = np.log1p(r["count"])
        toxic[i] = r["toxic"]
        evidence[i] = x[i].sum()
    some = (toxic == 1) & (evidence > 0)
    cuts = np.quantile(evidence[some], [1 / 3, 2 / 3]) if some.any() else np.zeros(2)
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, evidence, side="left"), 0)
    w, t = fit_ordinal(x, grade)
    return Model(kept, w, t)


def _predict(shared):
    def run(batches):
        m = shared.value
        for b in batches:
            for t in text_slices(b):
                p = m.probabilities(*word_counts(t, m.buckets))
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index("doc_id")).slice(t.rows.start, len(t)),
                     pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(1).astype(np.int32)),
                     pa.array(p[:, 0] >= 0.5)], names=["doc_id", "severity", "score", "grade", "toxic"])
    return run


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, severity`` (expected grade), ``score`` (P(grade >= 1)), ``grade``
    and ``toxic`` for every row of ``docs``."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _predict(shared), f"doc_id {kind}, severity double, score double, grade int, toxic boolean")


def op5_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return severity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
