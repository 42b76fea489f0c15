"""PASS / WARN / FAIL grading as column expressions.

Each ``grade_*`` takes the metric frame of one check (see ``checks``) and
adds ``status`` and ``detail``; thresholds enter as literals.  Percentages
are compared after rounding, as reported.  The expressions of a kind refer
to metric columns only (the tested column's name is a metric column too),
so they are built once per kind and threshold set and reused by every
check of that kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preflight.config import Thresholds
from preflight.functions.text import int_text, pct_text

# The words of a result, and those of the details below.
PASS, WARN, FAIL, SKIP = "PASS", "WARN", "FAIL", "SKIP"
NO_ROWS = "no rows"

_CACHE: dict = {}


def _cached(key, build):
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


def pk_exprs() -> dict[str, Column]:
    def build():
        d, t = F.col("duplicate_count"), F.col("total_rows")
        return {
            "status": F.when(d > 0, FAIL).otherwise(PASS),
            "detail": F.concat(int_text(d), F.lit(" duplicate "), F.col("pk_column"),
                               F.lit(" values out of "), int_text(t), F.lit(" rows")),
        }
    return _cached("pk", build)


def null_rate_exprs(t: Thresholds = Thresholds()) -> dict[str, Column]:
    def build():
        pct = F.col("null_pct")
        rate = pct / F.lit(100.0)
        return {
            "status": (F.when(pct.isNull(), FAIL)
                        .when(rate > F.lit(t.null_rate_fail), FAIL)
                        .when(rate > F.lit(t.null_rate_warn), WARN)
                        .otherwise(PASS)),
            "detail": F.when(pct.isNull(), F.lit(NO_ROWS)).otherwise(F.concat(
                int_text("null_count"), F.lit(" nulls in "), F.col("column_name"),
                F.lit(" ("), pct_text(pct, 4), F.lit("%) out of "),
                int_text("total_rows"), F.lit(" rows"))),
        }
    return _cached(("null", t), build)


def fk_exprs(t: Thresholds = Thresholds()) -> dict[str, Column]:
    def build():
        pct = F.col("match_pct")
        rate = pct / F.lit(100.0)
        return {
            "status": (F.when(pct.isNull(), FAIL)
                        .when(rate < F.lit(t.fk_match_rate_fail), FAIL)
                        .when(rate < F.lit(t.fk_match_rate_warn), WARN)
                        .otherwise(PASS)),
            "detail": F.when(pct.isNull(), F.lit(NO_ROWS)).otherwise(F.concat(
                int_text("matched_rows"), F.lit("/"), int_text("child_rows"),
                F.lit(" rows match "), F.col("parent_model"), F.lit(" ("),
                pct_text(pct, 2), F.lit("%)"))),
        }
    return _cached(("fk", t), build)


def row_count_exprs() -> dict[str, Column]:
    def build():
        n = F.coalesce(F.col("row_count"), F.lit(0))
        return {"status": F.when(n == 0, FAIL).otherwise(PASS),
                "detail": F.concat(int_text(n), F.lit(" rows"))}
    return _cached("rowcount", build)


def grade_pk_duplicates(m: DataFrame) -> DataFrame:
    return m.withColumns(pk_exprs())


def grade_null_rate(m: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return m.withColumns(null_rate_exprs(t))


def grade_fk_match_rate(m: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return m.withColumns(fk_exprs(t))


def grade_row_count(m: DataFrame) -> DataFrame:
    return m.withColumns(row_count_exprs())


def grade_unexpected_values(u: DataFrame) -> DataFrame:
    """One row from the unexpected-value groups: PASS when none, else WARN
    with the number of values and of their rows.  The values themselves are a
    table of their own (``fused.value_rows``): their number has no bound."""
    k, n = F.col("unexpected_count"), F.col("unexpected_rows")
    return (u.agg(F.count(F.lit(1)).alias("unexpected_count"),
                  F.coalesce(F.sum("row_count"), F.lit(0)).cast("long").alias("unexpected_rows"))
             .select("unexpected_count", F.when(k == 0, PASS).otherwise(WARN).alias("status"),
                     F.when(k == 0, F.lit("No unexpected values found")).otherwise(F.concat(
                         int_text(k), F.lit(" unexpected value(s) in "), int_text(n), F.lit(" rows")))
                      .alias("detail")))


def distribution_aggs(column: str) -> list[Column]:
    k = F.count(F.lit(1))
    return [k.alias("distinct_values"), F.lit(PASS).alias("status"),
            F.concat(k.cast("string"), F.lit(" distinct values in "), F.lit(column)).alias("detail")]


def grade_value_distribution(dist: DataFrame, column: str) -> DataFrame:
    """Informational: always PASS, ``k distinct values in col`` (NULL is a
    value)."""
    return dist.agg(*distribution_aggs(column))


def grade_rows_returned(df: DataFrame) -> DataFrame:
    """Any other check: PASS with ``N row(s) returned``."""
    k = F.count(F.lit(1))
    return df.agg(F.lit(PASS).alias("status"),
                  F.concat(k.cast("string"), F.lit(" row(s) returned")).alias("detail"))
