"""Table resolution (S1, P7) and multi-document catalog loading."""

import json
import os
import tempfile

import pytest

from preflight.sources.catalog import load_manifest
from preflight.sources.tables import TableNotFound, TableResolver, map_relation

from conftest import MANIFEST


def test_map_relation(spark):
    m = {"tmp_": "live_", "lake": "pond"}
    assert map_relation(spark, "lake.tmp_core.tmp_t", m) == "lake.live_core.live_t"    # first match, everywhere
    assert map_relation(spark, "lake.core.lake_t", m) == "pond.core.pond_t"
    assert map_relation(spark, "sea.t", m) == "sea.t"


def test_same_table_name_in_two_schemas(spark):
    r = TableResolver(spark, tables={"a.t": spark.range(1), "b.t": spark.range(2)}, use_session_catalog=False)
    assert (r.resolve("a.t").count(), r.resolve("b.t").count()) == (1, 2)
    with pytest.raises(TableNotFound, match="ambiguous"):
        r.resolve("t")
    with pytest.raises(TableNotFound):
        r.resolve("c.t")
    assert r.mapped({"z": "b"}).resolve("z.t").count() == 2 and r.schema_map == {}


def test_resolver_sources(spark):
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("pf_view")
    r = TableResolver(spark, tables={"X.y.z": spark.range(3)}, schema_map={"OLD": "X"})
    assert r.resolve("OLD.y.z").count() == 3                     # remapped, registered
    assert r.resolve("pf_view").count() == 1                     # session catalog
    with pytest.raises(TableNotFound):
        r.resolve("no.such.table")
    p = TableResolver(spark, parquet_dir="/root/testdata/sf0.001", use_session_catalog=False)
    assert p.resolve("ANY.schema.region").count() == 5


def test_many_manifests_one_job(spark):
    d = tempfile.mkdtemp(prefix="pf-manifests-", dir="/tmp")
    doc = json.load(open(MANIFEST))
    json.dump(doc, open(os.path.join(d, "a.json"), "w"))
    other = json.loads(json.dumps(doc).replace("model.wheels.", "model.wheels2."))
    json.dump(other, open(os.path.join(d, "b.json"), "w"))
    cat = load_manifest(spark, [os.path.join(d, "a.json"), os.path.join(d, "b.json")])
    assert cat.model_count().collect()[0][0] == 8
    assert cat.rules.count() == 12
    assert cat.edges.filter("dst like 'model.%'").count() == 8
