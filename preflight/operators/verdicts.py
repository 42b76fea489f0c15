"""J8 / O5 — reviewers' verdicts merged into edge-case results.

Verdicts arrive as ``index, verdict, status`` rows (a later row for the same
index wins for text and status).  Any in-range verdict with status clear or
expected clears ``flagged``, and a later one never sets it back.
Out-of-range indexes are ignored; verdicts of an earlier batch stay unless a
later one replaces them.  One join against the verdicts grouped
by index; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflight.functions.columns import verdict_rank

VERDICT_STATUSES = ("clear", "expected", "investigate", "action_required")
CLEARING = ("clear", "expected")


def merge_verdicts(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``results`` has ``index`` and ``flagged``; ``verdicts`` has ``index,
    verdict, status, ordinal`` (ordinal: input order).  Adds or updates
    ``verdict, verdict_status`` and ``flagged``; a result without a new verdict
    keeps the one it has."""
    if "ordinal" not in verdicts.columns:
        raise ValueError("verdicts need an ordinal column (their input order)")
    g = verdicts.groupBy("index").agg(
        F.max_by(F.struct("verdict", "status"), "ordinal").alias("_new"),
        F.bool_or(F.col("status").isin(*CLEARING)).alias("_clears"))
    old = {c: (F.col(c) if c in results.columns else F.lit(None).cast("string"))
           for c in ("verdict", "verdict_status")}
    j = results.join(g, "index", "left")
    fresh = F.col("_new").isNotNull()
    return j.withColumns({
        "verdict": F.when(fresh, F.col("_new.verdict")).otherwise(old["verdict"]),
        "verdict_status": F.when(fresh, F.col("_new.status")).otherwise(old["verdict_status"]),
        "flagged": F.col("flagged") & ~F.coalesce(F.col("_clears"), F.lit(False)),
    }).drop("_new", "_clears")


def verdict_counts(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``updated`` (in-range verdict rows, repeats included), ``total``."""
    total = results.agg(F.count(F.lit(1)).alias("total"))
    updated = verdicts.join(results.select("index"), "index", "left_semi").agg(
        F.count(F.lit(1)).alias("updated"))
    return updated.select("updated", total.scalar().alias("total"))


def sort_verdicts(merged: DataFrame) -> DataFrame:
    """action_required, then investigate, then the rest; input order
    within each."""
    return merged.orderBy(verdict_rank("verdict_status"), "index")
