"""Property checks: the join-free, pre-aggregated operators against the
direct definitions on random inputs (NULL keys, fan-out, composite keys)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from preflight.operators import checks as C
from preflight.operators import edge_cases as E

key = st.one_of(st.none(), st.integers(0, 4))
rows = st.lists(st.tuples(key, key), min_size=0, max_size=25)
SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(child=rows, parent=rows)
def test_fk_equals_plain_left_join(spark, child, parent):
    c = spark.createDataFrame(child, "a int, b int")
    p = spark.createDataFrame(parent, "x int, y int")
    m = C.fk_match_rate(c, p, ["a", "b"], "p", parent_keys=["x", "y"]).collect()[0]
    j = c.join(p, (c.a == p.x) & (c.b == p.y), "left")
    assert m["child_rows"] == j.count()
    want = j.filter(F.col("x").isNotNull()).count() if child else None
    assert m["matched_rows"] == want


@SETTINGS
@given(left=rows, right=rows)
def test_dropped_rows_and_nulls(spark, left, right):
    lf = spark.createDataFrame(left, "k int, v int")
    rf = spark.createDataFrame(right, "k int, w int")
    d = E.dropped_rows(lf, rf, ["k"]).collect()[0]
    assert d["dropped_rows"] == lf.join(rf.select("k").distinct(), "k", "left_anti").count()
    n = E.left_join_nulls(lf, rf, ["k"], ["w"]).collect()[0]
    j = lf.alias("l").join(rf.alias("r"), F.col("l.k") == F.col("r.k"), "left")
    assert n["joined_rows"] == j.count()
    assert n["null_count"] == j.filter(F.col("r.w").isNull()).count()


@SETTINGS
@given(before=rows, after=rows)
def test_result_diff_equals_except_all(spark, before, after):
    b = spark.createDataFrame(before, "k int, v int")
    a = spark.createDataFrame(after, "k int, v int")
    r = E.result_diff(b, a).collect()[0]
    assert r["rows_lost"] == b.exceptAll(a).count()
    assert r["rows_gained"] == a.exceptAll(b).count()


@SETTINGS
@given(data=rows)
def test_duplicates_equal_count_minus_distinct(spark, data):
    df = spark.createDataFrame(data, "k int, v int")
    got = C.pk_duplicates(df, "k").collect()[0]["duplicate_count"]
    want = df.agg((F.count("*") - F.countDistinct("k")).alias("d")).collect()[0]["d"]
    assert got == want
