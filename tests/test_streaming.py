"""The stream harness: table checks per micro-batch via foreachBatch."""

import os
import tempfile

from pyspark.sql import functions as F

from preflight.streaming import review_batches
from preflight.streaming.batches import batch_checks


def test_batch_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k long, v string")
    rows = {(r["check"], r["target"]): (r["status"], r["detail"])
            for r in batch_checks(df, ["k"], ["v"]).collect()}
    assert rows[("row_count", "")] == ("PASS", "3 rows")
    assert rows[("pk_duplicates", "k")][0] == "FAIL"
    assert rows[("null_rate", "v")] == ("FAIL", "1 nulls in v (33.3333%) out of 3 rows")


def test_review_batches(spark):
    base = tempfile.mkdtemp(prefix="pf-stream-", dir="/tmp")
    src, sink, ckpt = (os.path.join(base, x) for x in ("in", "out", "ckpt"))
    spark.createDataFrame([(1, "a"), (2, None)], "k long, v string").write.parquet(os.path.join(src, "b1"))
    spark.createDataFrame([(3, "c"), (3, "d")], "k long, v string").write.parquet(os.path.join(src, "b2"))
    stream = (spark.readStream.schema("k long, v string")
              .option("recursiveFileLookup", "true").parquet(src))
    q = review_batches(stream, sink, ckpt, unique=["k"], not_null=["v"], trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.filter(F.col("check") == "row_count").agg(F.sum(F.regexp_extract("detail", r"^(\d+)", 1)
                                                               .cast("int"))).collect()[0][0] == 4
    assert set(out.columns) >= {"check", "target", "status", "detail", "batch_id"}
