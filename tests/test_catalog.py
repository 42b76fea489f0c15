"""Catalog source: manifest → models / rules / edges."""

from pyspark.sql import functions as F

from conftest import P


def test_counts(catalog):
    assert catalog.model_count().collect()[0][0] == 4
    assert catalog.test_count().collect()[0][0] == 7


def test_model_by_name(catalog):
    r = catalog.model_by_name("rides").collect()
    assert [(x["relation_name"], x["materialized"]) for x in r] == [("lake.core.rides", "incremental")]
    assert catalog.model_by_name("boats").count() == 0


def test_model_by_id(catalog):
    assert catalog.model_by_id(P + "city_report").collect()[0]["name"] == "city_report"


def test_columns_keep_document_order(catalog):
    assert catalog.model_by_name("rides").collect()[0]["columns"] == ["ride_id", "station_id", "kind", "minutes"]


def test_rules(catalog):
    rows = catalog.rules.orderBy("model_id", "ordinal").collect()
    assert [(r["model_id"][len(P):], r["rule"], r["column"]) for r in rows] == [
        ("rides", "accepted_values", "kind"), ("rides", "unique", "ride_id"),
        ("rides", "accepted_values", "minutes"), ("rides", "not_null", "minutes"),
        ("stations", "unique", "station_id"), ("stations", "not_null", "city")]
    # the last rule's values at the first one's place
    assert rows[0]["accepted_values"] == ["day", "night", "tour"]


def test_depends_on_models_only(catalog):
    deps = {r["name"]: r["depends_on"] for r in catalog.models.collect()}
    assert deps["stations"] == []          # a seed is no model
    assert deps["city_report"] == [P + "station_load", P + "stations"]


def test_child_models(catalog):
    ch = {r["unique_id"]: r["child_models"] for r in catalog.child_models().collect()}
    assert ch[P + "stations"] == [P + "rides", P + "city_report"]
    assert ch[P + "station_load"] == [P + "city_report"]


def test_raw_code(catalog):
    assert "minutes" in catalog.model_by_name("rides").collect()[0]["raw_code"]
    assert catalog.model_by_name("stations").collect()[0]["raw_code"] == ""


def test_repeated_accepted_values(spark):
    """Values of the last, place of the first: columns a, b, a give a, b."""
    from preflight.sources.catalog import declare_catalog
    cat = declare_catalog(spark, [{"name": "t", "columns": ["a", "b"]}],
                          [("t", "accepted_values", "a", ["1"]), ("t", "accepted_values", "b", ["2"]),
                           ("t", "accepted_values", "a", ["3", "4"]), ("t", "unique", "a"), ("t", "unique", "a")])
    rows = cat.rules.orderBy("ordinal").collect()
    assert [(r["column"], r["accepted_values"]) for r in rows if r["rule"] == "accepted_values"] == [
        ("a", ["3", "4"]), ("b", ["2"])]
    assert len([r for r in rows if r["rule"] == "unique"]) == 2


def test_first_name_wins(spark):
    from preflight.sources.catalog import declare_catalog
    cat = declare_catalog(spark, [{"name": "a", "relation_name": "r1"}])
    dup = cat.models.unionByName(cat.models.withColumn("unique_id", F.lit("model.x.a2"))
                                 .withColumn("ordinal", F.lit(9).cast("long"))
                                 .withColumn("relation_name", F.lit("r2")))
    from preflight.sources.catalog import Catalog
    c2 = Catalog(dup, cat.rules, cat.edges, cat.nodes)
    assert c2.model_by_name("a").collect()[0]["relation_name"] == "r1"


def test_missing_manifest(spark):
    import pytest

    from preflight.sources.catalog import load_manifest
    with pytest.raises(FileNotFoundError):
        load_manifest(spark, "/tmp/definitely-not-here/target/manifest.json")


def test_two_manifests_that_share_ids(spark, tmp_path):
    """Rules and edges meet within their document; the latest snapshot of a
    project counts; an id of two projects is read from the later document."""
    import json

    from preflight.sources.catalog import load_manifest

    def manifest(name, project, at, rule, values, table, children):
        node = lambda uid, **more: {"unique_id": uid, "name": uid.split(".")[-1], "columns": {"k": {}}, **more}
        test = f"test.{project}.t"
        doc = {"metadata": {"generated_at": at, "project_name": project},
               "nodes": {"model.shared.base": node("model.shared.base", relation_name=f"{table}.base"),
                         f"model.{project}.own": node(f"model.{project}.own", relation_name=f"{table}.own"),
                         test: {"unique_id": test, "column_name": "k",
                                "test_metadata": {"name": rule, "kwargs": {"values": values}}}},
               "child_map": {"model.shared.base": children, f"model.{project}.own": [test]}}
        (tmp_path / name).write_text(json.dumps(doc))

    manifest("a1.json", "a", "2024-01-01", "unique", None, "a1", ["model.a.own"])
    manifest("a2.json", "a", "2024-03-01", "accepted_values", ["x"], "a2", ["test.a.t", "model.a.own"])
    manifest("b.json", "b", "2024-02-01", "not_null", None, "b", ["model.b.own"])
    cat = load_manifest(spark, str(tmp_path))
    assert {r["unique_id"]: r["relation_name"] for r in cat.models.collect()} == {
        "model.shared.base": "a2.base", "model.a.own": "a2.own", "model.b.own": "b.own"}
    assert {(r["model_id"], r["rule"]) for r in cat.rules.collect()} == {
        ("model.shared.base", "accepted_values"), ("model.a.own", "accepted_values"), ("model.b.own", "not_null")}
    assert {(r["src"], r["dst"], r["pos"]) for r in cat.edges.collect()} == {
        ("model.shared.base", "test.a.t", 0), ("model.shared.base", "model.a.own", 1),
        ("model.a.own", "test.a.t", 0), ("model.b.own", "test.b.t", 0)}
    assert cat.test_count().collect()[0][0] == 2
    assert cat.child_models().filter("unique_id = 'model.shared.base'").collect()[0]["child_models"] == ["model.a.own"]
