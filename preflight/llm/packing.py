"""Operator 7 — length buckets with the least padding, and token-budget
batches inside them.

The exact histogram of lengths comes from one aggregation; distinct lengths
are at most about the square root of twice the tokens of all texts.  Dynamic
programming over it, on the lower hull of the last cuts' lines, chooses the
``n_buckets`` upper bounds that minimise the total padding, in whole numbers
and in time linear in the distinct lengths.  In a bucket of bound L, a batch holds ``budget // L`` texts
(one at least), filled in a fixed order: texts are dealt by hash to chunks
of about ``CHUNK_ROWS``, numbered inside their chunk, and shifted by the
counts of the chunks before.  Equal rows are one row with their number until
their places are known, and are listed ``COPIES`` at a time; so neither a
bucket nor a row that a third of the table repeats is one task.

Lengths are tokens (``token_count``).

Cases: null and empty texts have length 0 and belong to the smallest
bucket; a text longer than the budget is a batch of its own; equal rows are
places of their own; ties in the order are equal rows; an empty table gives
an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from preflight.llm.token_count import count_tokens
from preflight.session import materialize

BUCKETS, BUDGET = 16, 32_768
CHUNK_ROWS = 20_000
COPIES = 4_096          # equal rows listed at once


def bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds (some of ``lengths``, ascending; the last is the largest)
    of at most ``n_buckets`` buckets with the least padding in total."""
    h = len(lengths)
    if not h:
        return []
    sizes = [int(x) for x in lengths]
    # padding of a bucket over lengths i..j: sizes[j] * texts - their tokens
    texts, tokens = [0], [0]
    for size, n in zip(sizes, counts):
        texts.append(texts[-1] + int(n))
        tokens.append(tokens[-1] + int(n) * size)
    best = [size * t - s for size, t, s in zip(sizes, texts[1:], tokens[1:])]
    begin = [np.zeros(h, np.int32)]          # first length of the last bucket of lengths 0..j
    for _ in range(1, min(n_buckets, h)):
        new, at = best.copy(), begin[-1].tolist()
        hull, front = [], 0                  # lines (slope, height, i): height - size * slope, least from front on
        for j in range(1, h):
            m, b = texts[j], best[j - 1] + tokens[j]
            while len(hull) - front >= 2:
                (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                if (b - b1) * (m2 - m1) > (b2 - b1) * (m - m1):
                    break
                hull.pop()
            hull.append((m, b, j))
            size = sizes[j]
            while front + 1 < len(hull) and hull[front + 1][1] - size * hull[front + 1][0] < \
                    hull[front][1] - size * hull[front][0]:
                front += 1
            m, b, i = hull[front]
            cost = b - size * m + size * texts[j + 1] - tokens[j + 1]
            if cost < new[j]:
                new[j], at[j] = cost, i
        best = new
        begin.append(np.array(at, np.int32))
    out, j = [], h - 1
    for at in reversed(begin):
        out.append(int(lengths[j]))
        if at[j] == 0:
            break
        j = int(at[j]) - 1
    return out[::-1]


def pack(rows: DataFrame, n_buckets: int = BUCKETS, budget: int = BUDGET, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rows`` (doc_id, length, and whatever tells them apart) with ``bucket``
    (from 0), ``pad_to``, ``batch`` (within the bucket) and ``slot``."""
    hist = (rows.groupBy(F.col("length").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy("length").toArrow())
    n = sum(hist["n"].to_pylist())
    ends = bounds(hist["length"].to_numpy().astype(np.int64), hist["n"].to_numpy().astype(np.int64), n_buckets)
    bucket, pad = F.lit(len(ends) - 1), F.lit(max(ends or [0]))
    for i in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("length") <= ends[i], F.lit(i)).otherwise(bucket)
        pad = F.when(F.col("length") <= ends[i], F.lit(ends[i])).otherwise(pad)
    names = [F.col(f"`{c}`") for c in rows.columns]
    chunks = max(1, -(-int(n) // chunk_rows))
    dealt = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__copies")).withColumns(
        {"bucket": bucket.cast("int"), "pad_to": pad.cast("long"),
         "__chunk": F.pmod(F.xxhash64(*names), F.lit(chunks)).cast("int")})
    count = dealt.groupBy("bucket", "__chunk").agg(F.sum("__copies").alias("__n"))
    before = count.withColumn("__before", F.sum("__n").over(
        Window.partitionBy("bucket").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.sum("__copies").over(Window.partitionBy("bucket", "__chunk").orderBy(*names)
                                 .rowsBetween(Window.unboundedPreceding, -1))
    at = F.col("__at")
    cap = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("pad_to"), F.lit(1))))
    placed = (dealt.withColumn("__own", own).join(before.drop("__n"), ["bucket", "__chunk"])
              .withColumn("__first", F.coalesce("__own", F.lit(0)) + F.coalesce("__before", F.lit(0)))
              .select(*names, "bucket", "pad_to", "__first", "__copies"))
    # copies: up to COPIES at once, more in parts that are dealt out first
    last = F.col("__copies") - 1
    few = placed.filter(F.col("__copies") <= COPIES).withColumn("__lo", F.lit(0).cast("long"))
    many = (placed.filter(F.col("__copies") > COPIES)
            .withColumn("__lo", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES).cast("long"))))
            .repartition(F.xxhash64(*names, "__lo")))
    return (few.unionByName(many)
            .withColumn("__k", F.explode(F.sequence("__lo", F.least(F.col("__lo") + F.lit(COPIES - 1), last))))
            .withColumn("__at", F.col("__first") + F.col("__k"))
            .select(*names, "bucket", "pad_to", F.floor(at / cap).cast("long").alias("batch"),
                    (at % cap).cast("int").alias("slot")))


def pack_documents(docs: DataFrame, n_buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``doc_id, length, bucket, pad_to, batch, slot`` of every row of
    ``docs``; lengths and ``budget`` are tokens."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(count_tokens(slim).withColumnRenamed("n_tokens", "length"), "lengths")
    return pack(rows, n_buckets, budget)


def op7_packing(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
