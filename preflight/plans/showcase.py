"""Query builders over the test tables used by ``__spark_entry__`` and the
benchmark.  Each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preflight.config import ReviewOptions, Thresholds
from preflight.functions.columns import sample_columns
from preflight.operators import checks as C
from preflight.operators import edge_cases as E
from preflight.operators import grade as G
from preflight.operators import report as R
from preflight.operators.lineage import blast_radius, row_lineage_edges
from preflight.operators.verdicts import merge_verdicts
from preflight.plans import demo_catalog as D
from preflight.plans.checks import plan_checks
from preflight.operators.fused import shared_fk_match_rates, value_rows
from preflight.plans.review import build_checks, results_frame, review
from preflight.sources.catalog import declare_catalog
from preflight.sources.tables import TableResolver


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def tables(spark: SparkSession, sf_dir: str, names) -> dict:
    """Each named table opened once; schema discovery runs concurrently."""
    from concurrent.futures import ThreadPoolExecutor

    names = list(dict.fromkeys(names))
    with ThreadPoolExecutor(max_workers=8) as pool:
        return dict(zip(names, pool.map(lambda n: table(spark, sf_dir, n), names)))


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def row_count_all(spark, sf_dir):
    t = tables(spark, sf_dir, D.TABLES)
    return _union([G.grade_row_count(C.row_count(t[n]))
                   .select(F.lit(n).alias("model"), "row_count", "status", "detail")
                   for n in D.TABLES])


PK_TARGETS = [("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"),
              ("events", "event_id"), ("lineitem", "l_orderkey"), ("documents", "text")]


def pk_duplicates(spark, sf_dir):
    t = tables(spark, sf_dir, [n for n, _ in PK_TARGETS])
    return _union([G.grade_pk_duplicates(C.pk_duplicates(t[n], c))
                   .select(F.lit(n).alias("model"), "*") for n, c in PK_TARGETS])


def pk_dup_sample(spark, sf_dir):
    return C.pk_sample(table(spark, sf_dir, "lineitem"), "l_orderkey")


def lineitem_with_nulls(spark, sf_dir):
    """lineitem with NULLs derived from the data: return flag 'R' and line
    status 'O' become NULL."""
    li = table(spark, sf_dir, "lineitem")
    return li.withColumns({"l_returnflag": F.expr("nullif(l_returnflag, 'R')"),
                           "l_linestatus": F.expr("nullif(l_linestatus, 'O')")})


NULL_COLUMNS = ["l_returnflag", "l_linestatus", "l_orderkey"]


def null_rate(spark, sf_dir):
    return G.grade_null_rate(C.null_rates(lineitem_with_nulls(spark, sf_dir), NULL_COLUMNS))


def null_sample(spark, sf_dir):
    df = lineitem_with_nulls(spark, sf_dir)
    cols = sample_columns(df.columns, "l_returnflag")
    return C.null_sample(df, "l_returnflag", cols)


def value_distribution(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn(
        "o_status_nullable", F.expr("nullif(o_orderstatus, 'P')"))
    out = []
    for col in ("o_orderpriority", "o_status_nullable"):
        out.append(C.value_distribution(o, col).select(
            F.lit(col).alias("column_name"), F.col("value").cast("string").alias("value"),
            "row_count", "pct"))
    return _union(out)


UNEXPECTED_TARGETS = [("orders", "o_orderstatus", ["F", "O"]),
                      ("part", "p_size", ["1", "2", "zz"]),
                      ("documents", "lang", ["en", "fr", "de", "es"]),
                      ("events", "event_type", ["click", "view", "purchase", "signup"])]


def unexpected_values(spark, sf_dir):
    t = tables(spark, sf_dir, [n for n, _, _ in UNEXPECTED_TARGETS])
    return _union([G.grade_unexpected_values(C.unexpected_values(t[n], c, acc))
                   .select(F.lit(n).alias("model"), F.lit(c).alias("column_name"), "*")
                   for n, c, acc in UNEXPECTED_TARGETS])


FK_TARGETS = [("documents", "labels", ["doc_id"], ["doc_id"]),
              ("lineitem", "orders", ["l_orderkey"], ["o_orderkey"]),
              ("orders", "lineitem", ["o_orderkey"], ["l_orderkey"]),
              ("lineitem", "part", ["l_partkey"], ["p_partkey"]),
              ("lineitem", "supplier", ["l_suppkey"], ["s_suppkey"]),
              ("orders", "customer", ["o_custkey"], ["c_custkey"]),
              ("events", "customer", ["user_id"], ["c_custkey"])]


def fk_match_rate(spark, sf_dir):
    """Seven foreign keys over eight tables, each table read once."""
    t = tables(spark, sf_dir, [x for c, p, _, _ in FK_TARGETS for x in (c, p)])
    rates = G.grade_fk_match_rate(shared_fk_match_rates(t, FK_TARGETS))
    child = F.element_at(F.array(*[F.lit(c) for c, *_ in FK_TARGETS]), F.col("fk") + 1)
    return rates.select(child.alias("model"), "*").drop("fk")


def fk_unmatched_sample(spark, sf_dir):
    return C.fk_sample(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"),
                       ["o_orderkey"], parent_keys=["l_orderkey"])


# ── the review of the declared catalog ──

def demo_built(spark, sf_dir):
    cat = D.demo_catalog(spark)
    specs = plan_checks(cat, D.model_names(), None, D.JOIN_KEYS)
    return build_checks(spark, specs, D.demo_resolver(spark, sf_dir), Thresholds())


def review_report(spark, sf_dir):
    return R.with_severity(results_frame(spark, demo_built(spark, sf_dir)))


def review_summary(spark, sf_dir):
    return R.summary(results_frame(spark, demo_built(spark, sf_dir)))


def section_counts(spark, sf_dir):
    return R.section_counts(results_frame(spark, demo_built(spark, sf_dir)))


def chart_series(spark, sf_dir):
    """A9 for the review's value_distribution checks (only those are
    planned)."""
    specs = plan_checks(D.demo_catalog(spark), D.model_names(), ["distribution"], D.JOIN_KEYS)
    res = D.demo_resolver(spark, sf_dir)
    parts = [R.chart_series(C.value_groups(res.resolve(s.relation), s.column),
                            f"{s.model}.{s.column}")
             for s in specs if s.check == "value_distribution"]
    return _union(parts)


# ── lineage over rows ──

BLAST_SEEDS = ["region:0"]
BLAST_DEPTH_SEEDS = ["nation:3", "part:7"]


def lineage_edges(spark, sf_dir):
    return row_lineage_edges(tables(spark, sf_dir,
                                    ("nation", "customer", "supplier", "orders", "lineitem")))


def blast_radius_rows(spark, sf_dir):
    return blast_radius(lineage_edges(spark, sf_dir), BLAST_SEEDS, 10, node_prefix=None)


def blast_radius_depth(spark, sf_dir):
    return blast_radius(lineage_edges(spark, sf_dir), BLAST_DEPTH_SEEDS, 2, node_prefix=None)


# ── edge-case templates ──

def dropped_rows(spark, sf_dir):
    return E.dropped_rows(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"),
                          ["o_orderkey"], ["l_orderkey"])


def left_join_nulls(spark, sf_dir):
    return E.left_join_nulls(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                             ["doc_id"], ["quality", "toxic"])


def filter_impact(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return E.filter_impact(ev, F.col("value") >= 10, by=["event_type"])


def composite_dups(spark, sf_dir):
    li = E.composite_dups(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    cv = E.composite_dups(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    return (li.select(F.lit("lineitem").alias("model"), "*")
              .unionByName(cv.select(F.lit("conversations").alias("model"), "*")))


def orders_after_change(spark, sf_dir):
    """A changed version of orders: prices of pending orders unknown
    (NULL), low-priority orders filtered out, urgent prices re-rated, a
    column dropped and one added."""
    o = table(spark, sf_dir, "orders")
    return (o.filter(F.col("o_orderpriority") != "5-LOW")
             .withColumn("o_totalprice",
                         F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("double"))
                          .when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") * 1.1)
                          .otherwise(F.col("o_totalprice")))
             .withColumn("o_year", F.year("o_orderdate"))
             .drop("o_orderdate"))


def coalesce_shift(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn(
        "o_totalprice", F.when(F.col("o_orderstatus") != "P",
                               F.col("o_totalprice").cast("decimal(18,2)")))
    out = E.coalesce_shift(o, "o_totalprice", 0, by=["o_orderpriority"])
    return out.select("o_orderpriority", "total_rows", "null_count",
                      F.col("sum_raw").cast("double").alias("sum_raw"),
                      F.col("sum_filled").cast("double").alias("sum_filled"),
                      F.round(F.col("sum_raw").cast("double") / (F.col("total_rows") - F.col("null_count")), 2)
                       .alias("avg_raw"),
                      F.round(F.col("sum_filled").cast("double") / F.col("total_rows"), 2)
                       .alias("avg_filled"))


def result_diff(spark, sf_dir):
    return E.result_diff(table(spark, sf_dir, "orders"), orders_after_change(spark, sf_dir))


# ── edge cases run as caller SQL, then verdicts ──

EDGE_CASES = [
    ("orders", "INNER JOIN to lineitem may drop orders without lines", "HIGH",
     "SELECT COUNT(*) AS dropped_orders FROM {orders} o LEFT ANTI JOIN {lineitem} l "
     "ON o.o_orderkey = l.l_orderkey"),
    ("conversations", "grain of (conv_id, turn) after the GROUP BY change", "MEDIUM",
     "SELECT COUNT(*) AS duplicate_keys FROM (SELECT conv_id, turn FROM {conversations} "
     "GROUP BY conv_id, turn HAVING COUNT(*) > 1)"),
    ("documents", "LEFT JOIN to labels leaves documents unlabeled", "HIGH",
     "SELECT COUNT(*) AS documents, SUM(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS unlabeled, "
     "ROUND(100.0 * SUM(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) / COUNT(*), 1) AS unlabeled_pct "
     "FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"),
    ("orders", "status mix after the new status filter", "LOW",
     "SELECT o_orderstatus, COUNT(*) AS orders, "
     "ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 1) AS pct "
     "FROM {orders} GROUP BY o_orderstatus ORDER BY orders DESC, o_orderstatus"),
    ("lineitem", "COALESCE on quantity leaves no negative quantities", "MEDIUM",
     "SELECT COUNT(CASE WHEN l_quantity < 0 THEN 1 END) AS negative_quantities, "
     "MIN(l_quantity) - MAX(l_quantity) AS spread FROM {lineitem}"),
    ("lineitem", "lines by supplier after the supplier filter", "LOW",
     "SELECT l_suppkey, COUNT(*) AS lines FROM {lineitem} GROUP BY l_suppkey"),
    ("events", "value of events the new filter removes", "LOW",
     "SELECT MAX(CASE WHEN value < 0 THEN value END) AS negative_value FROM {events}"),
]
EDGE_SAMPLES = {0: "SELECT o.o_orderkey, o.o_orderstatus FROM {orders} o LEFT ANTI JOIN {lineitem} l "
                   "ON o.o_orderkey = l.l_orderkey ORDER BY o.o_orderkey LIMIT 5"}


def edge_case_frames(spark, sf_dir):
    return tables(spark, sf_dir, ("orders", "lineitem", "conversations", "documents", "labels",
                                  "events"))


def edge_case_results(spark, sf_dir):
    cases = [E.EdgeCase(m, d, r, sql, sample_sql=EDGE_SAMPLES.get(i))
             for i, (m, d, r, sql) in enumerate(EDGE_CASES)]
    return E.run_edge_cases(spark, cases, edge_case_frames(spark, sf_dir))


def edge_case_run(spark, sf_dir):
    return edge_case_results(spark, sf_dir).results.select(
        "index", "model", "description", "risk", "flagged", "result", "n_rows")


def edge_case_rows(spark, sf_dir):
    """Every result row and every sample row, as JSON and text."""
    return edge_case_results(spark, sf_dir).rows


VERDICTS = [(0, "257 orders have no lines; they vanish under INNER JOIN.", "investigate"),
            (1, "No repeated (conv_id, turn) keys.", "clear"),
            (2, "60% unlabeled is expected: labels cover a sample.", "expected"),
            (3, "Even status mix.", "investigate"),
            (3, "Even status mix is by design.", "expected"),
            (3, "Status mix needs a second look.", "investigate"),
            (9, "out of range", "clear")]
#: A second batch: replaces one verdict, adds one, leaves the others.
MORE_VERDICTS = [(4, "No negative quantity.", "clear"), (1, "Grain confirmed.", "expected")]


def verdict_merge(spark, sf_dir):
    res = edge_case_results(spark, sf_dir).results
    for batch in (VERDICTS, MORE_VERDICTS):
        v = spark.createDataFrame([(i, t, s, k) for k, (i, t, s) in enumerate(batch)],
                                  "index long, verdict string, status string, ordinal long")
        res = merge_verdicts(res, v)
    return res.select("index", "model", "flagged", "verdict", "verdict_status", "result")


# ── keys of different types, upper-case columns, every value ──

def mixed_fk_match_rate(spark, sf_dir):
    """Foreign keys whose two sides have different types: half keys match
    nothing, text is compared as a number."""
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") + F.when(F.col("l_linenumber") == 2, 0.5).otherwise(0.0)).alias("order_ref"),
        F.concat(F.lit("0"), F.col("l_suppkey").cast("string")).alias("supp_ref"),
        F.col("l_partkey").cast("decimal(12,2)").alias("part_ref"))
    t = tables(spark, sf_dir, ("orders", "supplier", "part"))
    out = []
    for parent, key, pkey in (("orders", "order_ref", "o_orderkey"), ("supplier", "supp_ref", "s_suppkey"),
                              ("part", "part_ref", "p_partkey")):
        m = C.fk_match_rate(li, t[parent], [key], parent, parent_keys=[pkey])
        out.append(G.grade_fk_match_rate(m))
    return _union(out)


VALUE_TARGETS = {"lineitem": {"l_suppkey": ["1", "2", "3", "zz"], "l_linestatus": ["O"]},
                 "part": {"p_size": ["1", "2"]}, "orders": {"o_orderstatus": []}}


def unexpected_value_rows(spark, sf_dir):
    """Every value of columns with accepted values, one scan per table."""
    parts = []
    for name, columns in VALUE_TARGETS.items():
        df = table(spark, sf_dir, name)
        parts.append(value_rows(df, columns, df.schema).select(F.lit(name).alias("model"), "*"))
    return _union(parts)


def upper_case_review(spark, sf_dir):
    """The review of a table with upper-case columns under lower-case rules,
    through ``review()``."""
    return _upper_review(spark, sf_dir).results


def review_samples(spark, sf_dir):
    """The samples of the same review's failing checks."""
    return _upper_review(spark, sf_dir).samples.select("model", "check", "row")


#: Checks of lineitem whose samples are taken together: NULLs, then repeated keys.
NULL_SAMPLES = {0: ("l_returnflag", ["l_orderkey", "l_linenumber"]),
                1: ("l_linestatus", ["l_partkey", "l_suppkey", "l_orderkey"]),
                2: ("l_returnflag", ["l_suppkey", "l_orderkey", "l_linenumber"])}
KEY_SAMPLES = {3: ("l_orderkey", []), 4: ("l_partkey", []), 5: ("l_suppkey", []), 6: ("l_returnflag", [])}


def sample_rows(spark, sf_dir):
    """The samples of many checks of one table: one scan for all NULL samples,
    one scan and one shuffle for all repeated keys."""
    li = lineitem_with_nulls(spark, sf_dir)
    return C.null_samples(li, NULL_SAMPLES).unionByName(C.pk_samples(li, KEY_SAMPLES))


def _upper_review(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("o_clerk", F.expr("nullif(o_orderstatus, 'P')"))
    li = table(spark, sf_dir, "lineitem")
    resolver = TableResolver(spark, {"wh.ORDERS": o.toDF(*[c.upper() for c in o.columns]), "wh.LINEITEM": li})
    catalog = declare_catalog(spark, [
        {"name": "orders", "relation_name": "wh.ORDERS", "columns": ["o_orderkey", "o_clerk"]},
        {"name": "lineitem", "relation_name": "wh.LINEITEM", "columns": ["l_orderkey"], "depends_on": ["orders"]}],
        [("orders", "unique", "o_orderkey"), ("orders", "not_null", "o_clerk"),
         ("orders", "accepted_values", "o_orderstatus", ["F"]), ("orders", "accepted_values", "o_orderpriority", ["x"]),
         ("orders", "accepted_values", "o_orderstatus", ["F", "O"]), ("orders", "not_null", "o_missing")])
    keys = {"lineitem": {"orders": [("l_orderkey", "o_orderkey")]}}
    return review(spark, catalog, resolver, ["orders", "lineitem"], options=ReviewOptions(join_keys=keys))


QUERIES = {
    "row_count_all": row_count_all,
    "pk_duplicates": pk_duplicates,
    "pk_dup_sample": pk_dup_sample,
    "null_rate": null_rate,
    "null_sample": null_sample,
    "value_distribution": value_distribution,
    "unexpected_values": unexpected_values,
    "fk_match_rate": fk_match_rate,
    "fk_unmatched_sample": fk_unmatched_sample,
    "review_report": review_report,
    "review_summary": review_summary,
    "section_counts": section_counts,
    "chart_series": chart_series,
    "blast_radius": blast_radius_rows,
    "blast_radius_depth": blast_radius_depth,
    "dropped_rows": dropped_rows,
    "left_join_nulls": left_join_nulls,
    "filter_impact": filter_impact,
    "composite_dups": composite_dups,
    "coalesce_shift": coalesce_shift,
    "result_diff": result_diff,
    "edge_case_run": edge_case_run,
    "edge_case_rows": edge_case_rows,
    "mixed_fk_match_rate": mixed_fk_match_rate,
    "unexpected_value_rows": unexpected_value_rows,
    "upper_case_review": upper_case_review,
    "review_samples": review_samples,
    "sample_rows": sample_rows,
    "verdict_merge": verdict_merge,
}
