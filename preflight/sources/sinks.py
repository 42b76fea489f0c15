"""Report and review stores (S6–S8) and verdict interpretation.

* ``write_report``: severity-sorted CSV with header
  ``status,category,model,check,importance,detail``; the frame holds one
  row per check, so it is written as one file (``coalesce(1)`` is sized by
  the number of checks, not by data).
* ``write_review`` / ``load_review``: the review document (summary, models,
  blast radius, duration, results, samples) as JSON, overwritten per review;
  beside it ``values``: every value of the columns with accepted values, a
  table, since their number has no bound.
* ``write_edge_cases`` / ``interpret``: edge-case results and their rows are
  tables of their own, so a new review never drops them and verdicts update
  the results by a join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preflight.operators.report import severity_sorted
from preflight.operators.verdicts import merge_verdicts, verdict_counts

REPORT_COLUMNS = ["status", "category", "model", "check", "importance", "detail"]


def write_report(results: DataFrame, path: str) -> str:
    """S6 + O1."""
    (severity_sorted(results).select(*REPORT_COLUMNS).coalesce(1)
     .write.mode("overwrite").option("header", True).csv(path))
    return path


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def write_review(review, path: str) -> str:
    """The review as one JSON document (results and samples nested)."""
    spark = review.results.sparkSession
    res = review.results.orderBy("ordinal").agg(F.collect_list(F.struct(*review.results.columns))
                                                .alias("results"))
    smp = review.samples.agg(F.collect_list(F.struct(*review.samples.columns)).alias("samples"))
    meta = spark.createDataFrame(
        [(dt.datetime.now(dt.timezone.utc).isoformat(), review.summary["fail"],
          review.summary["warn"], review.summary["pass"], list(review.models_reviewed),
          list(review.blast_radius), float(review.duration_seconds))],
        "timestamp string, fail long, warn long, pass long, models_reviewed array<string>, "
        "blast_radius array<string>, duration_seconds double")
    doc = (meta.select("timestamp", F.struct("fail", "warn", "pass").alias("summary"),
                       "models_reviewed", "blast_radius", "duration_seconds")
           .withColumn("results", res.scalar()).withColumn("samples", smp.scalar()))
    doc.coalesce(1).write.mode("overwrite").json(f"{path}/review")
    if review.values is not None:
        review.values.write.mode("overwrite").parquet(f"{path}/values")
    return path


def load_values(spark: SparkSession, path: str) -> DataFrame:
    """``model, column_name, value, row_count, unexpected`` of a stored review."""
    return spark.read.parquet(f"{path}/values")


def load_review(spark: SparkSession, path: str):
    """S7 source: the stored review row, or None when there is none.  One that
    is there and cannot be read raises."""
    if not _exists(spark, f"{path}/review"):
        return None
    df = spark.read.json(f"{path}/review")
    if "results" not in df.columns:
        raise ValueError(f"the review stored at {path} cannot be read")
    return df


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def review_results(doc: DataFrame) -> DataFrame:
    """Stored review → results table (``ordinal, model, check, status, …``)."""
    return doc.select(F.explode("results").alias("r")).select("r.*")


def last_summary(spark: SparkSession, path: str) -> dict | None:
    """Time and counts of the stored review: ``timestamp, fail, warn, pass``."""
    doc = load_review(spark, path)
    if doc is None:
        return None
    r = doc.select("timestamp", "summary.*").first()
    return {"timestamp": r["timestamp"], "fail": r["fail"], "warn": r["warn"], "pass": r["pass"]}


def write_edge_cases(run, path: str) -> str:
    """Results and rows of ``run_edge_cases``, overwritten per run.  Verdicts
    on an earlier run's results are left behind with them."""
    spark = run.results.sparkSession
    run.rows.write.mode("overwrite").parquet(f"{path}/rows")
    run.results.write.mode("overwrite").parquet(f"{path}/results")
    where, fs = _fs(spark, f"{path}/judged")
    fs.delete(where, True)
    return path


def _judged(spark: SparkSession, path: str) -> list[int]:
    """Versions of the judged results that are whole, ascending."""
    where, fs = _fs(spark, f"{path}/judged")
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()
                  and _exists(spark, f"{path}/judged/{n}/_SUCCESS"))


def load_edge_cases(spark: SparkSession, path: str) -> DataFrame:
    """The stored results with the verdicts so far."""
    versions = _judged(spark, path)
    return spark.read.parquet(f"{path}/judged/v{versions[-1]}" if versions else f"{path}/results")


def interpret(spark: SparkSession, path: str, verdicts: DataFrame, out_path: str | None = None) -> dict:
    """Merge verdicts into the stored edge-case results, those of earlier
    calls included, and store them as the next version beside them (or at
    ``out_path``, a store of its own).  A version is read once it is whole, so
    a call that breaks off changes nothing.  Returns ``updated`` and ``total``."""
    versions = _judged(spark, path)
    stored = load_edge_cases(spark, path)
    target = f"{out_path}/results" if out_path else f"{path}/judged/v{(versions or [0])[-1] + 1}"
    merge_verdicts(stored, verdicts).write.mode("overwrite").parquet(target)
    c = verdict_counts(stored, verdicts).collect()[0]
    return {"updated": c["updated"], "total": c["total"]}
