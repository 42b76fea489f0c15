"""A declared catalog over the order / document tables of the test data.

It plays the part of a project manifest: models (one per table), their
rules and lineage.  TPC-H style tables name a key differently on each side
(``l_orderkey`` / ``o_orderkey``), so foreign keys are given as overrides
with (child column, parent column) pairs; ``documents → labels`` shares the
name ``doc_id`` and is inferred.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from preflight.sources.catalog import Catalog, declare_catalog
from preflight.sources.tables import TableResolver

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Models in review order: (name, columns, depends_on).
MODELS = [
    ("region", ["r_regionkey", "r_name"], []),
    ("nation", ["n_nationkey", "n_name", "n_regionkey"], ["region"]),
    ("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], ["nation"]),
    ("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], ["nation"]),
    ("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], []),
    ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                "o_orderpriority"], ["customer"]),
    ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                  "l_shipdate"], ["orders", "part", "supplier"]),
    ("labels", ["doc_id", "quality", "toxic"], []),
    ("documents", ["doc_id", "text", "lang", "source", "n_chars"], ["labels"]),
    ("events", ["event_id", "ts", "user_id", "event_type", "value", "props"], []),
    ("conversations", ["conv_id", "turn", "role", "text"], []),
    ("embeddings", ["vec_id", "embedding", "label"], []),
    ("pages", ["page_id", "url", "html"], []),
    ("benchmark", ["item_id", "text"], []),
]

# Declared rules: (model, rule, column[, accepted values]).
RULES = [
    ("region", "unique", "r_regionkey"),
    ("nation", "unique", "n_nationkey"),
    ("customer", "unique", "c_custkey"),
    ("customer", "not_null", "c_custkey"),
    ("customer", "not_null", "c_nationkey"),
    ("customer", "accepted_values", "c_mktsegment",
     ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
    ("supplier", "unique", "s_suppkey"),
    ("part", "unique", "p_partkey"),
    ("part", "accepted_values", "p_size", ["1", "2", "zz"]),
    ("orders", "unique", "o_orderkey"),
    ("orders", "not_null", "o_orderkey"),
    ("orders", "not_null", "o_custkey"),
    ("orders", "accepted_values", "o_orderstatus", ["F", "O"]),
    ("orders", "accepted_values", "o_orderpriority",
     ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]),
    ("lineitem", "unique", "l_orderkey"),
    ("lineitem", "not_null", "l_returnflag"),
    ("lineitem", "accepted_values", "l_returnflag", ["A", "N", "R"]),
    ("labels", "unique", "doc_id"),
    ("labels", "accepted_values", "quality", ["0", "1"]),
    ("labels", "accepted_values", "toxic", ["0"]),
    ("documents", "unique", "doc_id"),
    ("documents", "unique", "text"),
    ("documents", "not_null", "text"),
    ("documents", "accepted_values", "lang", ["en", "fr", "de", "es"]),
    ("events", "unique", "event_id"),
    ("events", "not_null", "user_id"),
    ("events", "accepted_values", "event_type", ["click", "view", "purchase", "signup"]),
    ("conversations", "unique", "conv_id"),
    ("embeddings", "unique", "vec_id"),
    ("pages", "unique", "page_id"),
    ("pages", "unique", "url"),
    ("benchmark", "unique", "item_id"),
]

# Foreign keys whose names differ between child and parent.
JOIN_KEYS = {
    "nation": {"region": [("n_regionkey", "r_regionkey")]},
    "customer": {"nation": [("c_nationkey", "n_nationkey")]},
    "supplier": {"nation": [("s_nationkey", "n_nationkey")]},
    "orders": {"customer": [("o_custkey", "c_custkey")]},
    "lineitem": {"orders": [("l_orderkey", "o_orderkey")],
                 "part": [("l_partkey", "p_partkey")],
                 "supplier": [("l_suppkey", "s_suppkey")]},
}

# SQL types of the columns with accepted values (for the SQL cross-check).
ACCEPTED_TYPES = {("part", "p_size"): "INTEGER", ("labels", "quality"): "INTEGER",
                  ("labels", "toxic"): "INTEGER"}

SCHEMA = "ANALYTICS.shop"


def relation(name: str) -> str:
    return f"{SCHEMA}.{name}"


def demo_catalog(spark: SparkSession) -> Catalog:
    models = [{"name": n, "relation_name": relation(n), "columns": cols, "depends_on": deps,
               "original_file_path": f"models/shop/{n}.sql"}
              for n, cols, deps in MODELS]
    return declare_catalog(spark, models, RULES, project="shop")


def demo_resolver(spark: SparkSession, sf_dir: str) -> TableResolver:
    return TableResolver(spark, parquet_dir=sf_dir, use_session_catalog=False)


def model_names() -> list[str]:
    return [m[0] for m in MODELS]
