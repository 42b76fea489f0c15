"""Changed files, diff splitting, refs and model context."""

from pyspark.sql import functions as F

from preflight.functions.text import file_stem, ref_names
from preflight.plans.context import changed_models, model_context, status
from preflight.sources.changes import diff_lines_from_text, model_paths, split_diffs

def patch(path, *lines):
    return "\n".join([f"diff --git a/{path} b/{path}", f"--- a/{path}", f"+++ b/{path}", *lines, ""])


RIDES = patch("models/core/rides.sql", "@@ -4,2 +4,3 @@", " FROM raw_rides r", "-WHERE r.minutes > 0",
              "+WHERE r.minutes > 5", "+  AND r.kind IS NOT NULL")
REPORT = patch("models/reports/city_report.sql", "@@ -1 +1 @@", "-SELECT city", "+SELECT lower(city) AS city",
               "@@ -9,0 +10 @@", "+ORDER BY 1")
HELPER = patch("macros/clean_city.sql", "@@ -2 +2 @@", "-trim(x)", "+trim(lower(x))")


def split(spark, text):
    rows = split_diffs(diff_lines_from_text(spark, {"d": text})).collect()
    return {r["path"]: r["diff"] for r in rows}


def test_files_are_split(spark):
    assert split(spark, RIDES) == {"models/core/rides.sql": RIDES}
    assert split(spark, REPORT + RIDES) == {"models/core/rides.sql": RIDES, "models/reports/city_report.sql": REPORT}


def test_other_files_dropped_and_empty(spark):
    assert split(spark, HELPER) == {}
    assert list(split(spark, HELPER + REPORT)) == ["models/reports/city_report.sql"]
    assert split(spark, "") == {}


def test_model_paths(spark):
    f = spark.createDataFrame([("models/b.sql",), ("models/schema.yml",), ("macros/x.sql",),
                               (" models/a.sql ",)], "path string")
    assert [r["path"] for r in model_paths(f).collect()] == ["models/a.sql", "models/b.sql"]


def test_refs_and_stem(spark):
    df = spark.createDataFrame([("select * from {{ ref('a') }} join {{ref(\"b\")}} "
                                 "join {{ ref('pkg', 'c') }}", "models/x/new_one.sql")],
                               "code string, path string")
    r = df.select(ref_names(F.col("code")).alias("r"), file_stem("path").alias("s")).collect()[0]
    assert r["r"] == ["a", "b"] and r["s"] == "new_one"


def test_changed_models(spark, catalog):
    f = spark.createDataFrame([("models/core/rides.sql",), ("models/core/tours.sql",)], "path string")
    rows = {r["name"]: r["is_new"] for r in changed_models(catalog, f).collect()}
    assert rows == {"rides": False, "tours": True}


def test_model_context(spark, catalog):
    f = spark.createDataFrame([("models/core/rides.sql",), ("models/core/tours.sql",)], "path string")
    diffs = split_diffs(diff_lines_from_text(spark, {"d": RIDES + patch("models/core/tours.sql", "+select 1")})
                        ).drop("diff_id")
    code = spark.createDataFrame([("models/core/tours.sql",
                                   "select * from {{ ref('rides') }} join {{ ref('nowhere') }}")],
                                 "path string, code string")
    last = spark.createDataFrame([(0, "rides", "row_count", "PASS", "8 rows")],
                                 "ordinal int, model string, check string, status string, detail string")
    ctx = {r["name"]: r for r in model_context(catalog, f, diffs, code, last, {"lake": "pond"}).collect()}
    old = ctx["rides"]
    assert old["relation_name"] == "pond.core.rides"
    assert old["upstream"] == ["stations"] and old["downstream"] == ["station_load"]
    assert old["upstream_tables"] == {"stations": "pond.raw.stations"}
    assert "r.kind IS NOT NULL" in old["diff"] and old["is_new"] is False
    assert old["existing_results"][0]["status"] == "PASS"
    new = ctx["tours"]
    assert new["is_new"] is True and new["upstream"] == ["rides"]
    assert new["upstream_tables"] == {"rides": "pond.core.rides"}
    assert "select 1" in new["diff"]


def test_status(spark, catalog):
    f = spark.createDataFrame([("models/core/station_load.sql",), ("models/new_thing.sql",)], "path string")
    s = status(catalog, f, {"fail": 1, "warn": 2, "pass": 3})
    assert s["models"] == 4 and s["tests"] == 7
    assert s["changed_models"] == ["station_load", "new_thing"]
    assert s["blast_radius"] == ["city_report"]
    assert s["last_review_summary"] == "1 FAIL / 2 WARN / 3 PASS"


def test_a_long_diff_is_split_in_chunks(spark, monkeypatch):
    """The same sections, whatever the chunk, and from files of any split."""
    import random
    import tempfile

    from preflight.sources import changes
    rnd = random.Random(3)
    text = "noise\n" + "".join(patch(f"models/m{rnd.randrange(40)}.sql", *[f"+line {rnd.random()}" for _ in range(rnd.randrange(30))])
                               for _ in range(120))
    want, at = {}, None
    for line in text.splitlines(keepends=True):
        if line.startswith("diff --git"):
            at = line.split()[3][2:]
            want[at] = ""
        if at:
            want[at] += line
    assert split(spark, text) == want
    monkeypatch.setattr(changes, "CHUNK", 16)
    assert split(spark, text) == want
    f = tempfile.NamedTemporaryFile("w", suffix=".diff", delete=False, dir="/tmp")
    f.write(text)
    f.close()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        lines = changes.diff_lines(spark, f.name)
        assert lines.rdd.getNumPartitions() > 5
        assert {r["path"]: r["diff"] for r in split_diffs(lines).collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_million_lines_of_one_diff(spark):
    """Numbered in chunks: no window sees more than one chunk's lines."""
    lines = spark.range(1_000_000).select(
        F.lit("d").alias("diff_id"), F.col("id").alias("line_no"),
        F.when(F.col("id") % 1000 == 0, F.concat(F.lit("diff --git a/models/x b/models/"), F.col("id").cast("string"), F.lit(".sql")))
         .otherwise(F.lit("+x")).alias("line"))
    got = split_diffs(lines).select("path", F.length("diff").alias("n"))
    assert got.count() == 1000 and got.filter("n < 1998").count() == 0


def test_repeated_refs_and_parents_of_one_name(spark):
    """A table that is referred to twice is listed twice and mapped once."""
    from preflight.plans.context import neighbors, new_model_refs
    from preflight.sources.catalog import declare_catalog
    cat = declare_catalog(spark, [{"name": "orders", "relation_name": "w.orders"}, {"name": "c", "relation_name": "w.c"}])
    code = spark.createDataFrame([("models/n.sql", "{{ ref('orders') }} {{ ref('c') }} {{ ref('orders') }}")], "path string, code string")
    r = new_model_refs(cat, code).collect()[0]
    assert r["upstream"] == ["orders", "c", "orders"] and r["upstream_tables"] == {"orders": "w.orders", "c": "w.c"}
    m = spark.createDataFrame([("", "model.a.t", "t", "w1.t", []), ("", "model.b.t", "t", "w2.t", []),
                               ("", "model.a.u", "u", "w1.u", ["model.a.t", "model.b.t"])],
                              "doc_id string, unique_id string, name string, relation_name string, depends_on array<string>")
    cat.models = m
    r = {x["unique_id"]: x for x in neighbors(cat).collect()}["model.a.u"]
    assert r["upstream"] == ["t", "t"] and r["upstream_tables"] == {"t": "w2.t"}


def test_diff_of_a_new_model_by_containment(spark):
    """First path that contains the name, by an equi-join on pieces of paths."""
    import contextlib
    import io
    import random

    from preflight.plans.context import model_diffs
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abc_") for _ in range(n))
    new = [(word(rnd.randrange(1, 14)), f"models/{i}.sql") for i in range(60)]
    paths = sorted({f"models/{word(rnd.randrange(3, 20))}/{word(9)}.sql" for _ in range(80)} |
                   {f"models/x/{n}.sql" for n, _ in new[::3]})
    changed = spark.createDataFrame([(p, n, None, True) for n, p in new] + [(paths[5], "known", "model.k", False)],
                                    "path string, name string, unique_id string, is_new boolean")
    diffs = spark.createDataFrame([(p, "text of " + p) for p in paths], "path string, diff string")
    out = model_diffs(changed, diffs)
    want = {(n, p): next((f"text of {x}" for x in paths if n in x), "") for n, p in new}
    want["known", paths[5]] = "text of " + paths[5]
    assert {(r["name"], r["path"]): r["diff"] for r in out.collect()} == want
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        out.explain()
    assert "NestedLoop" not in shown.getvalue() and "Cartesian" not in shown.getvalue()
