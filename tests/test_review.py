"""The review end to end (R1, R2, E8–E10) and its sinks."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from preflight.config import ReviewOptions
from preflight.operators import report as R
from preflight.operators.edge_cases import EdgeCase, run_edge_cases
from preflight.plans.review import review
from preflight.sources import sinks
from preflight.sources.tables import TableResolver


@pytest.fixture(scope="module")
def done(spark, catalog, wheel_tables):
    res = TableResolver(spark, tables=wheel_tables, use_session_catalog=False)
    return review(spark, catalog, res, models=["rides"])


def by_check(rv):
    return {(r["check"], r["target"]): (r["status"], r["detail"]) for r in rv.results.collect()}


def test_review_results(done):
    assert by_check(done) == {
        ("pk_duplicates", "ride_id"): ("FAIL", "3 duplicate ride_id values out of 8 rows"),
        ("null_rate", "minutes"): ("FAIL", "1 nulls in minutes (12.5%) out of 8 rows"),
        ("value_distribution", "kind"): ("PASS", "5 distinct values in kind"),
        ("unexpected_values", "kind"): ("WARN", "2 unexpected value(s) in 3 rows"),
        ("value_distribution", "minutes"): ("PASS", "4 distinct values in minutes"),
        ("unexpected_values", "minutes"): ("WARN", "1 unexpected value(s) in 1 rows"),
        ("fk_match_rate", "stations"): ("FAIL", "5/8 rows match stations (62.5%)"),
        ("row_count", ""): ("PASS", "8 rows")}
    assert done.summary == {"fail": 3, "warn": 2, "pass": 3}
    assert done.blast_radius == ["city_report", "station_load"]
    assert done.models_reviewed == ["rides"]


def test_samples_only_for_failing(done):
    s = done.samples.collect()
    assert {r["check"] for r in s} == {"pk_duplicates", "null_rate", "fk_match_rate"}
    pk = [json.loads(r["row"]) for r in s if r["check"] == "pk_duplicates"]
    assert pk == [{"ride_id": 73, "occurrences": 3}, {"ride_id": 72, "occurrences": 2}]
    fk = {(json.loads(r["row"]).get("station_id"), json.loads(r["row"])["unmatched_rows"])
          for r in s if r["check"] == "fk_match_rate"}
    assert fk == {(None, 1), (8, 1), (9, 1)}


def test_dry_run(spark, catalog, wheel_tables):
    res = TableResolver(spark, tables=wheel_tables, use_session_catalog=False)
    rv = review(spark, catalog, res, models=["rides"], options=ReviewOptions(dry_run=True))
    rows = rv.results.collect()
    assert len(rows) == 8 and {r["status"] for r in rows} == {"SKIP"}
    assert rv.summary == {"fail": 0, "warn": 0, "pass": 0}


def test_missing_column_and_table(spark, catalog, wheel_tables):
    tables = {k: v for k, v in wheel_tables.items() if k != "lake.raw.stations"}
    tables["lake.core.rides"] = wheel_tables["lake.core.rides"].drop("kind")
    res = TableResolver(spark, tables=tables, use_session_catalog=False)
    r = by_check(review(spark, catalog, res, models=["rides"]))
    assert r["unexpected_values", "kind"] == ("FAIL", "SQL error: column kind not found in lake.core.rides")
    assert r["fk_match_rate", "stations"][1].startswith("SQL error:")
    assert r["row_count", ""] == ("PASS", "8 rows") and r["unexpected_values", "minutes"][0] == "WARN"


def test_one_failing_column_fails_its_checks_only(spark, catalog, wheel_tables, done):
    """kind raises at run time; the other checks of the table keep their results."""
    tables = dict(wheel_tables)
    tables["lake.core.rides"] = tables["lake.core.rides"].withColumn(
        "kind", F.when(F.col("ride_id") == 74, F.raise_error(F.lit("bad kind")).cast("string")).otherwise(F.col("kind")))
    r = by_check(review(spark, catalog, TableResolver(spark, tables=tables, use_session_catalog=False), models=["rides"]))
    want = by_check(done)
    for key, got in r.items():
        if key[1] == "kind":
            assert got[0] == "FAIL" and "bad kind" in got[1]
        else:
            assert got == want[key]


def test_check_that_cannot_be_planned(spark, catalog, wheel_tables, done):
    """Accepted values of an array column: that check fails, no other."""
    tables = dict(wheel_tables)
    tables["lake.core.rides"] = tables["lake.core.rides"].withColumn("kind", F.array("kind"))
    r = by_check(review(spark, catalog, TableResolver(spark, tables=tables, use_session_catalog=False), models=["rides"]))
    assert r["unexpected_values", "kind"][0] == "FAIL" and r["unexpected_values", "kind"][1].startswith("SQL error:")
    assert r["unexpected_values", "minutes"] == by_check(done)["unexpected_values", "minutes"]
    assert r["row_count", ""] == ("PASS", "8 rows")


def test_upper_case_columns(spark, catalog, wheel_tables, done):
    tables = {k: v.toDF(*[c.upper() for c in v.columns]) for k, v in wheel_tables.items()}
    rv = review(spark, catalog, TableResolver(spark, tables=tables, use_session_catalog=False), models=["rides"])
    assert {k: v[0] for k, v in by_check(rv).items()} == {k: v[0] for k, v in by_check(done).items()}


def test_schema_map_of_the_review(spark, catalog, wheel_tables):
    res = TableResolver(spark, tables={"pond" + k[4:]: v for k, v in wheel_tables.items()}, schema_map={"x": "y"},
                        use_session_catalog=False)
    rv = review(spark, catalog, res, models=["rides"], options=ReviewOptions(schema_map={"lake": "pond"}))
    assert by_check(rv)["row_count", ""] == ("PASS", "8 rows") and res.schema_map == {"x": "y"}


def test_unknown_model_listed(spark, catalog, wheel_tables):
    res = TableResolver(spark, tables=wheel_tables, use_session_catalog=False)
    rv = review(spark, catalog, res, models=["boats", "station_load"])
    assert rv.models_reviewed == ["boats", "station_load"]
    assert [r["check"] for r in rv.results.collect()] == ["row_count"]
    with pytest.raises(ValueError):
        review(spark, catalog, res, models=[])


def test_changed_files_drive_review(spark, catalog, wheel_tables):
    res = TableResolver(spark, tables=wheel_tables, use_session_catalog=False)
    files = spark.createDataFrame([("models/core/station_load.sql",), ("models/new.sql",)], "path string")
    rv = review(spark, catalog, res, changed_files=files, options=ReviewOptions(categories=("rowcount",)))
    assert rv.models_reviewed == ["station_load"]
    assert rv.blast_radius == ["city_report"]


def test_report_and_store(spark, done):
    out = tempfile.mkdtemp(prefix="pf-report-", dir="/tmp")
    sinks.write_report(done.results, os.path.join(out, "compare"))
    rows = sinks.read_report(spark, os.path.join(out, "compare")).collect()
    assert list(rows[0].asDict()) == sinks.REPORT_COLUMNS
    assert [r["status"] for r in rows] == ["FAIL"] * 3 + ["WARN"] * 2 + ["PASS"] * 3
    assert [r["check"] for r in rows][:3] == ["pk_duplicates", "null_rate", "fk_match_rate"]
    sinks.write_review(done, os.path.join(out, "review"))
    doc = sinks.load_review(spark, os.path.join(out, "review"))
    assert doc.collect()[0]["summary"]["fail"] == 3
    assert sinks.review_results(doc).count() == 8
    assert sinks.load_values(spark, os.path.join(out, "review")).count() == 9
    assert sinks.load_review(spark, os.path.join(out, "missing")) is None
    os.makedirs(os.path.join(out, "broken", "review"))
    with open(os.path.join(out, "broken", "review", "part-0.json"), "w") as f:
        f.write('{"summary": ')
    with pytest.raises(Exception):
        sinks.load_review(spark, os.path.join(out, "broken"))


def test_report_shapes(spark, done):
    s = R.summary(done.results).collect()[0]
    assert (s["fail"], s["warn"], s["pass"]) == (3, 2, 3)
    sec = {(r["category"], r["status"]): r["results"] for r in R.section_counts(done.results).collect()}
    assert sec[("grain", "FAIL")] == 2 and sec[("join", "FAIL")] == 1
    rs = R.report_sections(done.results, None, 1, 1).collect()[0]
    assert (rs["sections"], rs["charts"]) == (6, 2)
    assert R.summary_text(done.results).collect()[0][0] == "3 FAIL / 2 WARN / 3 PASS"


def test_interpret_store(spark):
    """A second batch of verdicts keeps what the first one said."""
    out = tempfile.mkdtemp(prefix="pf-ec-", dir="/tmp")
    cases = [EdgeCase("m", "d", "HIGH", "SELECT 3 AS n"), EdgeCase("m", "e", "LOW", "SELECT explode(sequence(1, 60)) AS n")]
    sinks.write_edge_cases(run_edge_cases(spark, cases), os.path.join(out, "ec"))
    assert spark.read.parquet(os.path.join(out, "ec", "rows")).count() == 61
    schema = "index long, verdict string, status string, ordinal long"
    first = spark.createDataFrame([(0, "ok", "expected", 0), (5, "x", "clear", 1)], schema)
    c = sinks.interpret(spark, os.path.join(out, "ec"), first, os.path.join(out, "ec2"))
    assert c == {"updated": 1, "total": 2}
    sinks.interpret(spark, os.path.join(out, "ec2"), spark.createDataFrame([(1, "look", "investigate", 0)], schema),
                    os.path.join(out, "ec3"))
    r = spark.read.parquet(os.path.join(out, "ec3", "results")).orderBy("index").collect()
    assert [(x["flagged"], x["verdict"], x["verdict_status"]) for x in r] == [
        (False, "ok", "expected"), (True, "look", "investigate")]


def test_verdicts_of_several_calls(spark):
    """Each call starts from the verdicts before it; a new run starts anew."""
    at = os.path.join(tempfile.mkdtemp(prefix="pf-ec-", dir="/tmp"), "ec")
    cases = [EdgeCase("m", "d", "HIGH", "SELECT 3 AS n"), EdgeCase("m", "e", "LOW", "SELECT 4 AS n")]
    schema = "index long, verdict string, status string, ordinal long"
    sinks.write_edge_cases(run_edge_cases(spark, cases), at)
    sinks.interpret(spark, at, spark.createDataFrame([(0, "known", "clear", 0)], schema))
    os.makedirs(os.path.join(at, "judged", "v2"))                       # a call that broke off
    assert sinks.interpret(spark, at, spark.createDataFrame([(1, "look", "investigate", 0)], schema)) == {
        "updated": 1, "total": 2}
    r = sinks.load_edge_cases(spark, at).orderBy("index").collect()
    assert [(x["flagged"], x["verdict"]) for x in r] == [(False, "known"), (True, "look")]
    sinks.write_edge_cases(run_edge_cases(spark, cases), at)
    assert all(x["flagged"] for x in sinks.load_edge_cases(spark, at).collect())


def test_wide_tables_split_scans(spark, catalog, wheel_tables, monkeypatch, done):
    import preflight.plans.review as RV
    monkeypatch.setattr(RV, "MAX_GROUPING_SETS", 1)
    res = TableResolver(spark, tables=wheel_tables, use_session_catalog=False)
    assert by_check(review(spark, catalog, res, models=["rides"])) == by_check(done)


def test_each_table_is_scanned_once(spark, monkeypatch):
    """All 63 checks of the declared catalog: one scan per table (14), whoever
    else needs its keys or values; what is left reads the written groups."""
    from preflight.operators import fused
    from preflight.plans import showcase as S
    from conftest import SF_SMALL
    run, scans = [], []
    plain = fused.TableGroups._run

    def counted(self, sets, specs, nulls):
        run.append([f.rsplit("/", 1)[-1] for f in self.df.inputFiles()])
        return plain(self, sets, specs, nulls)

    monkeypatch.setattr(fused.TableGroups, "_run", counted)
    built = S.demo_built(spark, SF_SMALL)
    assert sorted(x[0] for x in run) == sorted(f"{t}.parquet" for t in S.D.TABLES)
    from preflight.plans.review import graded_frame, value_frame
    for frame in (graded_frame(spark, built), value_frame(spark, built)):
        files = frame.inputFiles()
        assert files and all("/preflight-groups-" in f for f in files)
        scans += files
    assert len([b for b in built if b.error]) == 0 and graded_frame(spark, built).count() == 63


def test_group_testing_of_a_failing_table(spark):
    """One bad check of 64 is found in about two actions per halving."""
    from preflight.operators.fused import TableReads
    from preflight.plans.checks import CheckSpec
    df = spark.range(20).select("id", *[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(64)])
    df = df.withColumn("c41", F.when(F.col("id") == 7, F.raise_error(F.lit("bad"))).otherwise(F.col("c41").cast("string")))
    specs = [CheckSpec(i, "grain", "t", "pk_duplicates", "TIER0", "t", f"c{i}") for i in range(64)]
    got = TableReads(df, df.schema, specs, [], 64)
    assert {m[0] for m in got.metrics} == set(range(64)) - {41}
    assert {m[0]: m[5] for m in got.metrics} == {i: 20 - min(20, i + 2) for i in range(64) if i != 41}
    assert got.actions <= 14


def test_all_values_are_kept(done):
    v = {(r["column_name"], r["value"]): (r["row_count"], r["unexpected"]) for r in done.values.collect()}
    assert v["kind", "dusk"] == (2, True) and v["kind", "day"] == (3, False) and v["kind", None] == (1, False)
    assert len(v) == 9
    assert {(r["column_name"], r["value"]) for r in done.unexpected_values().collect()} == {
        ("kind", "dusk"), ("kind", "dawn"), ("minutes", "30")}


def test_released_groups_are_deleted(spark, catalog, wheel_tables):
    from preflight.session import scratch_files
    before = set(scratch_files(spark))
    rv = review(spark, catalog, TableResolver(spark, tables=wheel_tables, use_session_catalog=False), models=["rides"])
    assert rv.values.count() == 9 and any("preflight-groups-" in p for p in set(scratch_files(spark)) - before)
    rv.release()
    assert not any("preflight-groups-" in p for p in set(scratch_files(spark)) - before)


def test_unknown_check_kind_passes(spark, wheel_tables):
    from preflight.plans.checks import CheckSpec
    from preflight.plans.review import build_checks, run_checks
    res = TableResolver(spark, tables=wheel_tables, use_session_catalog=False)
    spec = CheckSpec(0, category="custom", model="rides", check="my_check",
                     importance="NORMAL", relation="lake.core.rides")
    rows = run_checks(spark, build_checks(spark, [spec], res))
    assert [(r["status"], r["detail"]) for r in rows] == [("PASS", "8 row(s) returned")]
