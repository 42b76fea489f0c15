"""Blast radius (G1/G2) — BFS semantics and the recursive-SQL cross-check."""

from preflight.operators.lineage import blast_radius, reached_models

from conftest import P


def ids(df):
    return sorted(r["unique_id"] for r in df.collect())


def test_reach_of_one(catalog):
    reach = {r["unique_id"]: r["depth"] for r in blast_radius(catalog.edges, [P + "stations"]).collect()}
    # city_report is one hop away, and three over rides
    assert reach == {P + "rides": 1, P + "city_report": 1, P + "station_load": 2}


def test_leaf(catalog):
    assert ids(blast_radius(catalog.edges, [P + "city_report"])) == []


def test_depth(catalog):
    assert ids(blast_radius(catalog.edges, [P + "rides"], max_depth=1)) == [P + "station_load"]
    assert ids(blast_radius(catalog.edges, [P + "rides"], max_depth=0)) == [P + "station_load"]


def test_seeds_excluded(catalog):
    r = blast_radius(catalog.edges, [P + "rides", P + "station_load"])
    assert ids(r) == [P + "city_report"]


def test_empty_graph(spark):
    e = spark.createDataFrame([], "src string, dst string")
    assert ids(blast_radius(e, ["model.x"])) == []


def test_cycle_and_cut(spark):
    e = spark.createDataFrame([("model.a", "model.b"), ("model.b", "model.a"),
                               ("model.b", "seed.s"), ("seed.s", "model.c")], "src string, dst string")
    r = {x["unique_id"]: x["depth"] for x in blast_radius(e, ["model.a"]).collect()}
    assert r == {"model.b": 1}


def test_depth_is_shortest(spark):
    e = spark.createDataFrame([("model.a", "model.b"), ("model.b", "model.c"), ("model.a", "model.c"),
                               ("model.c", "model.d")], "src string, dst string")
    r = {x["unique_id"]: x["depth"] for x in blast_radius(e, ["model.a"]).collect()}
    assert r == {"model.b": 1, "model.c": 1, "model.d": 2}


def test_names(catalog):
    reach = blast_radius(catalog.edges, [P + "rides"])
    assert sorted(r["name"] for r in reached_models(catalog, reach).collect()) == [
        "city_report", "station_load"]


def test_matches_recursive_sql(spark):
    import random
    rnd = random.Random(7)
    edges = [(f"model.n{rnd.randrange(40)}", f"model.n{rnd.randrange(40)}") for _ in range(90)]
    e = spark.createDataFrame(edges, "src string, dst string")
    e.createOrReplaceTempView("g_edges")
    got = {r["unique_id"]: r["depth"] for r in blast_radius(e, ["model.n1", "model.n2"], 3).collect()}
    want = {r[0]: r[1] for r in spark.sql("""
        WITH RECURSIVE reach(id, depth) AS (
          SELECT dst, 1 FROM g_edges WHERE src IN ('model.n1', 'model.n2')
          UNION ALL
          SELECT e.dst, r.depth + 1 FROM reach r JOIN g_edges e ON e.src = r.id WHERE r.depth < 3)
        SELECT id, min(depth) FROM reach WHERE id NOT IN ('model.n1', 'model.n2') GROUP BY id
    """).collect()}
    assert got == want


def test_large_frontier_path(spark):
    """A tiny broadcast budget forces the shuffled-hash path; same answer."""
    import random
    rnd = random.Random(11)
    edges = [(f"model.n{rnd.randrange(60)}", f"model.n{rnd.randrange(60)}") for _ in range(200)]
    e = spark.createDataFrame(edges, "src string, dst string")
    want = {r["unique_id"]: r["depth"] for r in blast_radius(e, ["model.n1"], 4).collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256")
        got = {r["unique_id"]: r["depth"] for r in blast_radius(e, ["model.n1"], 4).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == want and len(got) > 2


def test_hot_source_is_salted(spark):
    """A hub owning most edges goes through the salted path; same answer."""
    edges = [(f"model.s{i}", "model.hub") for i in range(10)]
    edges += [("model.hub", f"model.x{j}") for j in range(100)]
    edges += [(f"model.x{j}", f"model.y{j % 7}") for j in range(100)]
    e = spark.createDataFrame(edges, "src string, dst string")
    seeds = [f"model.s{i}" for i in range(10)] + ["model.hub"]
    want = {r["unique_id"]: r["depth"] for r in blast_radius(e, seeds[:10], 5, partitions=8).collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256")
        got = {r["unique_id"]: r["depth"] for r in blast_radius(e, seeds[:10], 5, partitions=8).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == want
    assert want["model.hub"] == 1 and want["model.x5"] == 2 and want["model.y3"] == 3
    assert len(want) == 1 + 100 + 7


def test_hot_sources_rule(spark):
    from preflight.operators.lineage import _hot_sources
    edges = [("h", f"d{i}") for i in range(60)] + [(f"s{i}", "x") for i in range(40)]
    e = spark.createDataFrame(edges, "src string, dst string")
    hot = {r["src"]: r["salts"] for r in _hot_sources(e, 100, 8).collect()}   # average load 12.5
    assert hot == {"h": 5}                                                    # ceil(60 * 8 / 100)
    assert _hot_sources(e, 100, 1).count() == 0


def test_size_settings(spark):
    from preflight.session import size_setting
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for text, want in (("10485760b", 10 << 20), ("64MB", 64 << 20), ("1KB", 1024), ("256k", 256 << 10), ("-1", -1), ("300", 300)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
            assert size_setting(spark, "spark.sql.autoBroadcastJoinThreshold", 5) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rounds_leave_no_files(spark):
    import glob
    import os
    from preflight.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    e = spark.createDataFrame([("model.a", "model.b"), ("model.b", "model.c")], "src string, dst string")
    before = set(glob.glob(os.path.join(base, "preflight-bfs-*")))
    r = blast_radius(e, ["model.a"])
    assert set(glob.glob(os.path.join(base, "preflight-bfs-*"))) - before == {
        f.removeprefix("file://").rsplit("/", 1)[0] for f in r.inputFiles()} and r.count() == 2


def test_bins_bound_the_count_of_sources(spark):
    """The count by source sees full hash bins only: of 5,000 small sources none, and the hub."""
    from preflight.operators.lineage import _hot_sources
    edges = [(f"s{i}", "x") for i in range(5000)] + [("h", f"d{i}") for i in range(3000)]
    e = spark.createDataFrame(edges, "src string, dst string")
    plan = _hot_sources(e, 8000, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "bin" in plan
    assert [tuple(r) for r in _hot_sources(e, 8000, 8).collect()] == [("h", 3)]


def test_strangers_are_not_shuffled(spark):
    """Of a large frontier's round only edges that may start in it reach the join; a filter never loses one."""
    from pyspark.sql import functions as F
    from preflight.operators.lineage import _maybe
    e = spark.createDataFrame([(f"n{i}", f"m{i}") for i in range(20_000)], "src string, dst string").withColumn(
        "key", F.xxhash64("src"))
    f = e.filter("dst LIKE 'm1%'").select("src", "key")
    size = f.count()
    left = _maybe(e, f, size)
    assert left.join(f.select("src"), "src").count() == size and left.count() < size + 5000
    assert _maybe(e, f, (1 << 25) + 1) is e
