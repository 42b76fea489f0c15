"""Rule catalog: models, declared rules and lineage edges as DataFrames.

Two ways in:

* ``load_manifest`` reads dbt-style ``manifest.json`` documents with
  ``spark.read.text(wholetext=True)`` + ``from_json`` (any number of files
  in one job) and explodes nodes, tests and ``child_map`` edges;
* ``declare_catalog`` builds the same frames from Python declarations.

Several documents are told apart: every frame has ``doc_id``, and names, rules
and edges meet within a document.  Of several snapshots of one project (by
``metadata.project_name``) the latest counts (``metadata.generated_at``, then
the document's name); an id that several projects hold is read from the
document that was generated last.

Frames (all lazy):

``models``  doc_id, unique_id, name, original_file_path, relation_name, database,
            schema, materialized, raw_code, columns ARRAY<STRING>,
            tags ARRAY<STRING>, depends_on ARRAY<STRING> (model ids only),
            ordinal BIGINT (document order)
``rules``   doc_id, model_id, rule, column, accepted_values ARRAY<STRING>, ordinal
``edges``   doc_id, src, dst, pos — every child_map edge, any node kind, and its
            place among the source's children
``nodes``   doc_id, unique_id — every node id (for test counts)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL_PREFIX = "model."
TEST_PREFIX = "test."
RULE_KINDS = ("unique", "not_null", "accepted_values")

MANIFEST_SCHEMA = """
metadata STRUCT<generated_at: STRING, project_name: STRING>,
nodes MAP<STRING, STRUCT<
  unique_id: STRING, name: STRING, original_file_path: STRING,
  relation_name: STRING, database: STRING, schema: STRING,
  config: STRUCT<materialized: STRING>,
  columns: MAP<STRING, STRUCT<name: STRING, description: STRING>>,
  tags: ARRAY<STRING>,
  depends_on: STRUCT<nodes: ARRAY<STRING>>,
  raw_code: STRING,
  column_name: STRING,
  test_metadata: STRUCT<name: STRING,
    kwargs: STRUCT<values: ARRAY<STRING>, column_name: STRING, model: STRING>>>>,
child_map MAP<STRING, ARRAY<STRING>>,
parent_map MAP<STRING, ARRAY<STRING>>
"""

MODELS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("unique_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("original_file_path", T.StringType()),
    T.StructField("relation_name", T.StringType()),
    T.StructField("database", T.StringType()),
    T.StructField("schema", T.StringType()),
    T.StructField("materialized", T.StringType()),
    T.StructField("raw_code", T.StringType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("depends_on", T.ArrayType(T.StringType())),
    T.StructField("ordinal", T.LongType()),
])

RULES_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("accepted_values", T.ArrayType(T.StringType())),
    T.StructField("ordinal", T.LongType()),
])

EDGES_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("pos", T.LongType()),
])


@dataclass
class Catalog:
    models: DataFrame
    rules: DataFrame
    edges: DataFrame
    nodes: DataFrame

    # ── S5 lookups (lazy) ──
    def model_count(self) -> DataFrame:
        return self.models.agg(F.count(F.lit(1)).alias("model_count"))

    def test_count(self) -> DataFrame:
        return (self.nodes.filter(F.col("unique_id").startswith(TEST_PREFIX))
                .agg(F.count(F.lit(1)).alias("test_count")))

    def model_by_id(self, unique_id: str) -> DataFrame:
        return self.models.filter(F.col("unique_id") == unique_id)

    def models_by_name(self) -> DataFrame:
        """One model per name: the first in document order (documents by name)."""
        first = (self.models.groupBy("name")
                 .agg(F.min_by("unique_id", F.struct("doc_id", "ordinal")).alias("unique_id")))
        return self.models.join(first, ["name", "unique_id"], "left_semi")

    def model_by_name(self, name: str) -> DataFrame:
        return self.models_by_name().filter(F.col("name") == name)

    def child_models(self) -> DataFrame:
        """``unique_id, child_models`` — direct model children, edge order."""
        e = (self.edges.filter(F.col("dst").startswith(MODEL_PREFIX)))
        return (e.groupBy(F.col("src").alias("unique_id"))
                 .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"])
                       .alias("child_models")))

    def rules_of(self, kind: str) -> DataFrame:
        return self.rules.filter(F.col("rule") == kind)


def load_manifest(spark: SparkSession, paths) -> Catalog:
    """Read manifest document(s) into catalog frames.

    ``paths`` is a file, a folder of manifests or a list.  Each document
    is one row (``wholetext``); the JSON is parsed on the executors."""
    if isinstance(paths, str):
        paths = [paths]
    try:
        raw = spark.read.text(list(paths), wholetext=True)
    except Exception as e:  # noqa: BLE001 - Spark reports a missing path at analysis
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise FileNotFoundError(
                f"manifest not found at {', '.join(paths)}; compile the project first") from e
        raise
    doc = raw.select(F.from_json("value", MANIFEST_SCHEMA).alias("m"),
                     F.input_file_name().alias("doc_id")).select("m.*", "doc_id")
    return catalog_from_documents(doc, several=len(raw.inputFiles()) > 1)


def latest_documents(doc: DataFrame) -> DataFrame:
    """Of each project's documents the latest; one without a project's name
    is its own project."""
    key = F.coalesce(F.col("metadata.project_name"), F.col("doc_id"))
    when = F.struct(F.coalesce("metadata.generated_at", F.lit("")), F.col("doc_id"))
    latest = doc.groupBy(key.alias("project")).agg(F.max_by("doc_id", when).alias("doc_id")).select("doc_id")
    return doc.join(latest, "doc_id", "left_semi")


def catalog_from_documents(doc: DataFrame, several: bool = True) -> Catalog:
    """Catalog frames from parsed documents.  ``several``: there may be more
    than one (else nothing has to be told apart)."""
    if "doc_id" not in doc.columns:
        doc = doc.withColumn("doc_id", F.lit(""))
    if "metadata" not in doc.columns:
        doc = doc.withColumn("metadata", F.lit(None).cast("struct<generated_at:string,project_name:string>"))
    keep = lambda frame, column: frame
    if several:
        doc = latest_documents(doc)
        ids = doc.select("doc_id", F.coalesce("metadata.generated_at", F.lit("")).alias("at"),
                         F.explode(F.map_keys("nodes")).alias("unique_id"))
        owner = ids.groupBy("unique_id").agg(F.max_by("doc_id", F.struct("at", "doc_id")).alias("doc_id"))

        def keep(frame, column):
            """Rows whose node is read from their document."""
            return frame.join(owner.withColumnRenamed("unique_id", column), ["doc_id", column], "left_semi")
    nodes = doc.select("doc_id", F.posexplode("nodes").alias("ordinal", "unique_id", "node"))
    nodes = nodes.withColumn("ordinal", F.col("ordinal").cast("long"))
    model_nodes = nodes.filter(F.col("unique_id").startswith(MODEL_PREFIX))
    n = F.col("node")
    models = keep(model_nodes, "unique_id").select(
        "doc_id", "unique_id",
        F.coalesce(n["name"], F.lit("")).alias("name"),
        F.coalesce(n["original_file_path"], F.lit("")).alias("original_file_path"),
        F.coalesce(n["relation_name"], F.lit("")).alias("relation_name"),
        F.coalesce(n["database"], F.lit("")).alias("database"),
        F.coalesce(n["schema"], F.lit("")).alias("schema"),
        F.coalesce(n["config"]["materialized"], F.lit("")).alias("materialized"),
        F.coalesce(n["raw_code"], F.lit("")).alias("raw_code"),
        F.coalesce(F.map_keys(n["columns"]), F.array().cast("array<string>")).alias("columns"),
        F.coalesce(n["tags"], F.array().cast("array<string>")).alias("tags"),
        F.filter(F.coalesce(n["depends_on"]["nodes"], F.array().cast("array<string>")),
                 lambda d: d.startswith(MODEL_PREFIX)).alias("depends_on"),
        "ordinal",
    )

    edges_pos = doc.select("doc_id", F.explode("child_map").alias("src", "children")).select(
        "doc_id", "src", F.posexplode("children").alias("pos", "dst"))
    edges_pos = keep(edges_pos, "src")
    edges = edges_pos.select("doc_id", "src", "dst", F.col("pos").cast("long").alias("pos"))

    # S3: tests hanging off each model, in child_map order
    test_nodes = nodes.filter(F.col("unique_id").startswith(TEST_PREFIX)).select(
        "doc_id", F.col("unique_id").alias("dst"),
        F.col("node")["test_metadata"]["name"].alias("rule"),
        F.col("node")["column_name"].alias("column"),
        F.col("node")["test_metadata"]["kwargs"]["values"].alias("accepted_values"),
    )
    tests = (edges_pos.filter(F.col("src").startswith(MODEL_PREFIX))
             .join(test_nodes, ["doc_id", "dst"])
             .filter(F.col("column").isNotNull() & (F.col("column") != "")
                     & F.col("rule").isin(*RULE_KINDS))
             .filter((F.col("rule") != "accepted_values")
                     | (F.size(F.coalesce("accepted_values", F.array())) > 0))
             .select("doc_id", F.col("src").alias("model_id"), "rule", "column",
                     F.when(F.col("rule") == "accepted_values", F.col("accepted_values"))
                      .alias("accepted_values"),
                     F.col("pos").cast("long").alias("ordinal")))
    rules = last_accepted_wins(tests)
    all_nodes = keep(nodes.select("doc_id", "unique_id"), "unique_id")
    return Catalog(models, rules, edges, all_nodes)


def last_accepted_wins(rules: DataFrame) -> DataFrame:
    """Several accepted_values tests on one column: the values of the last at
    the place of the first.  unique / not_null duplicates are kept (each is
    reviewed)."""
    keys = [c for c in ("doc_id", "model_id", "column") if c in rules.columns]
    av = (rules.filter(F.col("rule") == "accepted_values").groupBy(*keys)
          .agg(F.first("rule").alias("rule"), F.max_by("accepted_values", "ordinal").alias("accepted_values"),
               F.min("ordinal").alias("ordinal")))
    return rules.filter(F.col("rule") != "accepted_values").unionByName(av)


def declare_catalog(spark: SparkSession, models: list[dict],
                    rules: list[tuple] | None = None,
                    extra_edges: list[tuple] | None = None,
                    project: str = "project") -> Catalog:
    """Catalog from declarations.

    ``models``: dicts with ``name``, ``relation_name``, ``columns`` and
    optionally ``depends_on`` (names), ``original_file_path``,
    ``materialized``, ``raw_code``, ``tags``.
    ``rules``: ``(model name, rule, column[, accepted values])``.
    Edges are parent -> child from ``depends_on`` plus ``extra_edges``
    (ids); rule edges model -> test node are added as a manifest has them.
    """
    uid = {m["name"]: f"{MODEL_PREFIX}{project}.{m['name']}" for m in models}
    mrows = []
    for i, m in enumerate(models):
        mrows.append((
            "", uid[m["name"]], m["name"], m.get("original_file_path", f"models/{m['name']}.sql"),
            m.get("relation_name", m["name"]), m.get("database", ""), m.get("schema", ""),
            m.get("materialized", "table"), m.get("raw_code", ""), list(m.get("columns", [])),
            list(m.get("tags", [])), [uid[d] for d in m.get("depends_on", []) if d in uid], i))
    rrows, erows, nrows = [], [], [("", u) for u in uid.values()]
    for m in models:
        for d in m.get("depends_on", []):
            if d in uid:
                erows.append(("", uid[d], uid[m["name"]], len(erows)))
    for i, r in enumerate(rules or []):
        name, kind, col = r[0], r[1], r[2]
        vals = [str(v) for v in r[3]] if len(r) > 3 and r[3] is not None else None
        tid = f"{TEST_PREFIX}{project}.{kind}_{name}_{col}.{i}"
        nrows.append(("", tid))
        erows.append(("", uid[name], tid, len(erows)))
        rrows.append(("", uid[name], kind, col, vals if kind == "accepted_values" else None, i))
    erows += [("", src, dst, len(erows) + i) for i, (src, dst) in enumerate(extra_edges or [])]
    models_df = spark.createDataFrame(mrows, MODELS_SCHEMA)
    rules_df = last_accepted_wins(spark.createDataFrame(rrows, RULES_SCHEMA))
    edges_df = spark.createDataFrame(erows, EDGES_SCHEMA)
    nodes_df = spark.createDataFrame(nrows, "doc_id string, unique_id string")
    return Catalog(models_df, rules_df, edges_df, nodes_df)
