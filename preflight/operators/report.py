"""Report shapes: summary (A7), section counts (A8), chart series (A9) and
the severity order (O1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflight.config import CATEGORIES
from preflight.functions.columns import importance_rank, status_rank
from preflight.functions.text import value_text


def with_severity(results: DataFrame) -> DataFrame:
    """Adds ``status_rank`` (FAIL 0, WARN 1, PASS 2, other 9) and
    ``importance_rank`` (TIER0 0, HIGH 1, NORMAL 2, other 9)."""
    return results.withColumns({"status_rank": status_rank("status"),
                                "importance_rank": importance_rank("importance")})


def severity_sorted(results: DataFrame) -> DataFrame:
    """O1: status, importance, model, check; input order breaks ties."""
    tie = ["ordinal"] if "ordinal" in results.columns else []
    return (with_severity(results)
            .orderBy("status_rank", "importance_rank", "model", "check", *tie)
            .drop("status_rank", "importance_rank"))


def summary(results: DataFrame) -> DataFrame:
    """``fail, warn, pass`` counts (SKIP and others not counted)."""
    s = F.col("status")
    return results.agg(*[F.count(F.when(s == k, 1)).alias(k.lower())
                         for k in ("FAIL", "WARN", "PASS")])


def summary_text(results: DataFrame) -> DataFrame:
    s = summary(results)
    return s.select(F.concat(F.col("fail").cast("string"), F.lit(" FAIL / "),
                             F.col("warn").cast("string"), F.lit(" WARN / "),
                             F.col("pass").cast("string"), F.lit(" PASS")).alias("summary"))


def section_counts(results: DataFrame) -> DataFrame:
    """Results per category and status."""
    return (results.filter(F.col("category").isin(*CATEGORIES))
            .groupBy("category", "status").agg(F.count(F.lit(1)).alias("results")))


def report_sections(results: DataFrame, semantic: DataFrame | None = None,
                    models_reviewed: int = 0, blast_radius: int = 0) -> DataFrame:
    """``sections`` (non-empty report sections) and ``charts`` (number
    of value_distribution results)."""
    present = results.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    n_cats = present.filter(F.col("category").isin(*CATEGORIES)).agg(
        F.count(F.lit(1)).alias("k"))
    extra = (1 if models_reviewed else 0) + (1 if blast_radius else 0)
    sem = 0 if semantic is None else (0 if semantic.isEmpty() else 1)
    charts = results.filter((F.col("category") == "distribution")
                            & (F.col("check") == "value_distribution")).agg(
        F.count(F.lit(1)).alias("charts"))
    return n_cats.select((F.col("k") + F.lit(extra + sem)).alias("sections"),
                         charts.scalar().alias("charts"))


def chart_series(distribution: DataFrame, title: str) -> DataFrame:
    """``title, label, value`` of one value distribution (labels as
    text, NULL as 'None')."""
    dtype = distribution.schema["value"].dataType
    return distribution.select(F.lit(title).alias("title"),
                               value_text(F.col("value"), dtype).alias("label"),
                               F.col("row_count").cast("long").alias("value"))
