"""Check planning from rules."""

from preflight.functions.columns import sample_columns
from preflight.plans.checks import join_keys, plan_checks


def kinds(specs):
    return [s.check for s in specs]


def test_grain_checks(catalog):
    specs = plan_checks(catalog, ["rides"], ["grain"])
    assert [(s.check, s.column, s.importance) for s in specs] == [
        ("pk_duplicates", "ride_id", "TIER0"), ("null_rate", "minutes", "HIGH")]


def test_distribution_checks(catalog):
    specs = plan_checks(catalog, ["rides"], ["distribution"])
    assert [(s.check, s.column, s.accepted) for s in specs if s.check == "unexpected_values"] == [
        ("unexpected_values", "kind", ("day", "night", "tour")), ("unexpected_values", "minutes", ("10", "20"))]
    assert kinds(specs).count("value_distribution") == 2


def test_join_checks_inferred(catalog):
    specs = plan_checks(catalog, ["rides"], ["join"])
    assert [(s.parent, s.keys, s.parent_relation) for s in specs] == [
        ("stations", ("station_id",), "lake.raw.stations")]
    assert plan_checks(catalog, ["city_report"], ["join"]) == []      # no shared tested column


def test_rowcount(catalog):
    specs = plan_checks(catalog, ["city_report"], ["rowcount"])
    assert [(s.check, s.relation) for s in specs] == [("row_count", "lake.reports.city_report")]


def test_all_categories_in_order(catalog):
    specs = plan_checks(catalog, ["rides"])
    assert [s.category for s in specs] == ["grain"] * 2 + ["distribution"] * 4 + ["join", "rowcount"]
    assert [s.ordinal for s in specs] == list(range(8))


def test_unknown_and_empty(catalog):
    assert plan_checks(catalog, ["boats"]) == []
    assert plan_checks(catalog, ["rides"], []) == []
    assert plan_checks(catalog, ["rides"], ["colour"]) == []


def test_models_named_twice_are_reviewed_twice(catalog):
    assert len(plan_checks(catalog, ["stations", "stations"], ["rowcount"])) == 2


def test_no_rules_no_grain(catalog):
    assert plan_checks(catalog, ["station_load"], ["grain"]) == []


def test_override(catalog):
    specs = plan_checks(catalog, ["city_report"], ["join"], {"city_report": {"stations": ["city"]}})
    assert [(s.keys, s.parent_keys) for s in specs] == [(("city",), ("city",))]
    specs = plan_checks(catalog, ["rides"], ["join"], {"rides": {"stations": [("station_id", "number")]}})
    assert specs[0].keys == ("station_id",) and specs[0].parent_keys == ("number",)


def test_join_keys_frame(catalog):
    assert [(r["child"], r["parent"], r["child_keys"]) for r in join_keys(catalog).collect()] == [
        ("rides", "stations", ["station_id"])]


def test_sample_columns():
    cols = ["amount", "order_id", "user_id", "status", "paid", "width", "x"]
    assert sample_columns(cols, "order_id") == ["user_id", "paid", "width", "amount"]
    assert sample_columns(["a"], "a") == []
    assert len(sample_columns(cols, None)) == 4
