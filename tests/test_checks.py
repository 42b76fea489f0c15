"""Mechanical checks and grading on literal corner inputs."""

import pytest
from pyspark.sql import functions as F

from preflight.config import Thresholds
from preflight.operators import checks as C
from preflight.operators import grade as G


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "k long, v string")


def test_empty_table(spark, empty):
    assert one(G.grade_row_count(C.row_count(empty)))["status"] == "FAIL"
    pk = one(G.grade_pk_duplicates(C.pk_duplicates(empty, "k")))
    assert (pk["status"], pk["total_rows"], pk["duplicate_count"]) == ("PASS", 0, 0)
    nr = one(G.grade_null_rate(C.null_rate(empty, "v")))
    assert nr["status"] == "FAIL" and nr["null_pct"] is None and nr["detail"] == "no rows"
    fk = one(G.grade_fk_match_rate(C.fk_match_rate(empty, empty, ["k"], "p")))
    assert fk["status"] == "FAIL" and fk["child_rows"] == 0 and fk["matched_rows"] is None


def test_null_key_counts_as_duplicate(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    pk = one(G.grade_pk_duplicates(C.pk_duplicates(df, "k")))
    assert pk["duplicate_count"] == 1 and pk["status"] == "FAIL"
    assert pk["detail"] == "1 duplicate k values out of 3 rows"
    assert C.pk_sample(df, "k").count() == 0


def test_pk_matches_count_distinct(spark):
    df = spark.createDataFrame([(i % 7 if i % 5 else None,) for i in range(100)], "k long")
    direct = df.agg((F.count("*") - F.countDistinct("k")).alias("d")).collect()[0]["d"]
    assert one(C.pk_duplicates(df, "k"))["duplicate_count"] == direct


def test_pk_sample_order(spark):
    df = spark.createDataFrame([(3,), (3,), (1,), (1,), (2,), (2,), (2,), (5,)], "k long")
    assert [tuple(r) for r in C.pk_sample(df, "k").collect()] == [(2, 3), (1, 2), (3, 2)]


def test_null_rate_grades(spark):
    t = Thresholds()
    cases = [(0, 1000, "PASS"), (5, 1000, "WARN"), (100, 1000, "FAIL"),
             (50, 1000, "WARN"),   # 5.0 % is not above 5 %
             (1, 1000, "PASS")]    # 0.1 % is not above 0.1 %
    for nulls, total, want in cases:
        df = spark.createDataFrame([(None if i < nulls else i,) for i in range(total)], "v long")
        assert one(G.grade_null_rate(C.null_rate(df, "v"), t))["status"] == want, (nulls, want)


def test_null_rate_custom_thresholds(spark):
    df = spark.createDataFrame([(None if i < 10 else i,) for i in range(1000)], "v long")
    r = one(G.grade_null_rate(C.null_rate(df, "v"), Thresholds(null_rate_fail=0.02, null_rate_warn=0.005)))
    assert r["status"] == "WARN"
    assert r["detail"] == "10 nulls in v (1.0%) out of 1,000 rows"


def test_null_pct_text(spark):
    df = spark.createDataFrame([(None if i < 1 else i,) for i in range(10000)], "v long")
    assert one(C.null_rate(df, "v"))["null_pct"] == 0.01
    df = spark.createDataFrame([(i,) for i in range(3)], "v long")
    assert "(0.0%)" in one(G.grade_null_rate(C.null_rate(df, "v")))["detail"]


def test_null_sample_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, 5, "c")], "id long, v long, s string")
    rows = C.null_sample(df, "v", ["id", "s"]).collect()
    assert [tuple(r) for r in rows] == [(1, "a"), (2, "b")]


def test_unexpected_values(spark):
    df = spark.createDataFrame([("a",), ("b",), ("x",), ("x",), ("y",), (None,)], "v string")
    r = one(G.grade_unexpected_values(C.unexpected_values(df, "v", ["a", "b"])))
    assert r["status"] == "WARN"
    assert r["detail"] == "2 unexpected value(s) in 3 rows"
    ok = one(G.grade_unexpected_values(C.unexpected_values(df, "v", ["a", "b", "x", "y"])))
    assert (ok["status"], ok["detail"]) == ("PASS", "No unexpected values found")


def test_unexpected_integer_with_bad_literal(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    r = one(G.grade_unexpected_values(C.unexpected_values(df, "v", ["1", "zz"])))
    assert r["unexpected_count"] == 2
    none_castable = one(G.grade_unexpected_values(C.unexpected_values(df, "v", ["zz"])))
    assert none_castable["unexpected_count"] == 3


def test_accepted_value_with_quote(spark):
    df = spark.createDataFrame([("it's",), ("x",)], "v string")
    r = one(G.grade_unexpected_values(C.unexpected_values(df, "v", ["it's"])))
    assert r["detail"] == "1 unexpected value(s) in 1 rows"


def test_value_distribution(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    rows = {r["value"]: (r["row_count"], r["pct"]) for r in C.value_distribution(df, "v").collect()}
    assert rows == {"a": (2, 50.0), "b": (1, 25.0), None: (1, 25.0)}
    g = one(G.grade_value_distribution(C.value_groups(df, "v"), "v"))
    assert (g["status"], g["detail"]) == ("PASS", "3 distinct values in v")


def test_fk_fan_out_and_null_child(spark):
    child = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k long")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    m = one(C.fk_match_rate(child, parent, ["k"], "p"))
    plain = child.alias("c").join(parent.alias("p"), F.col("c.k") == F.col("p.k"), "left")
    assert m["child_rows"] == plain.count() == 5
    assert m["matched_rows"] == plain.filter(F.col("p.k").isNotNull()).count() == 3
    smp = [tuple(r) for r in C.fk_sample(child, parent, ["k"]).collect()]
    assert smp == [(None, 1), (3, 1)]


def test_fk_grades(spark):
    t = Thresholds()

    def grade(matched, total):
        child = spark.createDataFrame([(i,) for i in range(total)], "k long")
        parent = spark.createDataFrame([(i,) for i in range(matched)], "k long")
        return one(G.grade_fk_match_rate(C.fk_match_rate(child, parent, ["k"], "p"), t))

    assert grade(100, 100)["status"] == "PASS"
    assert grade(95, 100)["status"] == "WARN"     # 95.0 % is not below 95 %
    assert grade(975, 1000)["status"] == "WARN"
    assert grade(99, 100)["status"] == "PASS"     # 99.0 % is not below 99 %
    assert grade(80, 100)["status"] == "FAIL"
    assert grade(80, 100)["detail"] == "80/100 rows match p (80.0%)"


def test_composite_fk(spark):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "x long, y string")
    parent = spark.createDataFrame([(1, "a"), (2, "a")], "px long, py string")
    m = one(C.fk_match_rate(child, parent, ["x", "y"], "p", parent_keys=["px", "py"]))
    assert (m["child_rows"], m["matched_rows"], m["join_keys"]) == (3, 2, "x, y")


def test_row_count_detail(spark):
    df = spark.range(52557)
    r = one(G.grade_row_count(C.row_count(df)))
    assert (r["status"], r["detail"]) == ("PASS", "52,557 rows")


def test_fused_table_checks(spark):
    from preflight.operators.fused import graded, table_checks
    from preflight.plans.checks import CheckSpec
    df = spark.createDataFrame([(1, "it's"), (1, "b\\c"), (2, None), (None, "q")], "k long, v string")
    base = dict(model="t", relation="t", category="x", importance="HIGH")
    specs = [CheckSpec(0, check="pk_duplicates", column="k", **base),
             CheckSpec(1, check="null_rate", column="v", **base),
             CheckSpec(2, check="value_distribution", column="v", **base),
             CheckSpec(3, check="unexpected_values", column="v", accepted=("it's",), **base),
             CheckSpec(4, check="unexpected_values", column="k", accepted=("1", "zz"), **base),
             CheckSpec(5, check="row_count", **base)]
    out = {r["ordinal"]: (r["status"], r["detail"])
           for r in graded(table_checks(df, specs, df.schema)).collect()}
    assert out[0] == ("FAIL", "2 duplicate k values out of 4 rows")
    assert out[1] == ("FAIL", "1 nulls in v (25.0%) out of 4 rows")
    assert out[2] == ("PASS", "4 distinct values in v")
    assert out[3] == ("WARN", "2 unexpected value(s) in 2 rows")
    assert out[4] == ("WARN", "1 unexpected value(s) in 1 rows")
    assert out[5] == ("PASS", "4 rows")


def test_keys_by_bitmap(spark):
    """Dense whole numbers: as many distinct values as grouping finds, with
    NULLs, negative values and repeated keys; others are grouped."""
    from preflight.operators.checks import dense_keys, distinct_by_bitmap, key_groups, pk_duplicates
    k = F.when(F.col("id") % 7 != 0, (F.col("id") * 3 % 70_001) - 40_000)
    df = spark.range(200_000).select(k.cast("int").alias("k"), (F.col("id") * 10**12).alias("far"),
                                     F.col("id").cast("string").alias("s"), F.lit(None).cast("long").alias("none"))
    assert dense_keys(df, "k") is not None
    assert distinct_by_bitmap(df, "k").first()[0] == df.agg(F.countDistinct("k")).first()[0]
    assert pk_duplicates(df, "k").collect() == pk_duplicates(df, "k", key_groups(df, "k")).collect()
    assert dense_keys(df, "far") is None and dense_keys(df, "s") is None and dense_keys(df, "none") is None
    assert [tuple(r) for r in pk_duplicates(df, "none").collect()] == [("none", 200_000, 200_000)]
    assert [tuple(r) for r in pk_duplicates(df.limit(0), "k").collect()] == [("k", 0, 0)]


def test_foreign_keys_over_shared_groups(spark):
    """NULL keys, fan-out, empty sides, keys of two columns and of different
    types, all at once, as each on its own."""
    from preflight.operators.checks import fk_match_rate
    from preflight.operators.fused import shared_fk_match_rates
    a = spark.createDataFrame([(1, 1, "1"), (1, 2, "x"), (None, 2, None), (3, None, "03"), (4, 4, "4")], "i int, j int, s string")
    b = spark.createDataFrame([(1, 1), (1, 2), (3, 3), (None, 2), (4, 4), (4, 4)], "i int, j int")
    frames = {"a": a, "b": b, "none": b.limit(0)}
    fks = [("a", "b", ["i"], ["i"]), ("a", "b", ["j"], ["j"]), ("a", "b", ["i", "j"], ["i", "j"]), ("a", "b", ["s"], ["i"]),
           ("b", "a", ["i"], ["i"]), ("none", "a", ["i"], ["i"]), ("a", "none", ["i"], ["i"]), ("b", "b", ["i"], ["j"])]
    got = {r["fk"]: tuple(r)[1:] for r in shared_fk_match_rates(frames, fks).collect()}
    for n, (c, p, k, pk) in enumerate(fks):
        one = fk_match_rate(frames[c], frames[p], k, p, parent_keys=pk).first()
        assert got[n][:3] == tuple(one)[:3] and got[n][4] == one["match_pct"] and (got[n][3] or 0) == (one["matched_rows"] or 0)
