"""Status (R3), model context (R4) and the joins under them.

All inputs are tables: the catalog frames, ``changed_files(path)``,
per-file diffs ``(path, diff)``, the code of new model files
``(path, code)`` and the stored results of the last review.  Every step is
a join; nothing is looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflight.functions.text import file_stem, ref_names
from preflight.operators.lineage import blast_radius, reached_models
from preflight.sources.catalog import MODEL_PREFIX, Catalog
from preflight.sources.changes import model_paths
from preflight.sources.tables import map_relation_col

#: Characters of a name by which it meets paths.
GRAM = 8
NEW_RELATION = "(new model — not yet materialized)"


def _last_by_name(entries, key: str, value):
    """Map from an array of entries; of a repeated name, the last entry."""
    last = F.filter(entries, lambda x, i: ~F.exists(
        F.slice(entries, i + 2, F.size(entries)), lambda y: y[key] == x[key]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x[key], value(x))))


def changed_models(catalog: Catalog, changed_files: DataFrame) -> DataFrame:
    """``path, unique_id, name, is_new`` — a path matches a catalog
    model by ``original_file_path``; unmatched paths are new models named
    by their file stem."""
    paths = model_paths(changed_files)
    idx = catalog.models.select(F.col("original_file_path").alias("path"), "unique_id",
                                F.col("name").alias("_name"))
    j = paths.join(idx, "path", "left")
    return j.select("path", "unique_id",
                    F.coalesce("_name", file_stem("path")).alias("name"),
                    F.col("unique_id").isNull().alias("is_new"))


def neighbors(catalog: Catalog, schema_map: dict | None = None) -> DataFrame:
    """Per model ``upstream`` names, ``upstream_tables`` (name →
    mapped relation) and direct model ``downstream`` names."""
    m = catalog.models
    up = (m.select("unique_id", F.posexplode("depends_on").alias("pos", "parent_id"))
          .join(m.select(F.col("unique_id").alias("parent_id"), F.col("name").alias("p_name"),
                         F.col("relation_name").alias("p_rel")), "parent_id")
          .groupBy("unique_id")
          .agg(F.array_sort(F.collect_list(F.struct("pos", "p_name", "p_rel"))).alias("ups")))
    up = up.select("unique_id",
                   F.transform("ups", lambda x: x["p_name"]).alias("upstream"),
                   _last_by_name("ups", "p_name", lambda x: map_relation_col(x["p_rel"], schema_map)).alias(
                       "upstream_tables"))
    e = catalog.edges.filter(F.col("dst").startswith(MODEL_PREFIX))
    down = (e.join(m.select(F.col("unique_id").alias("dst"), F.col("name").alias("c_name")), "dst")
            .groupBy(F.col("src").alias("unique_id"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c_name"))),
                             lambda x: x["c_name"]).alias("downstream")))
    return m.select("unique_id").join(up, "unique_id", "left").join(down, "unique_id", "left")


def new_model_refs(catalog: Catalog, new_code: DataFrame) -> DataFrame:
    """``path, upstream, upstream_tables`` of new model files from
    their single-argument ``ref('…')`` calls; names not in the catalog are
    dropped."""
    refs = new_code.select("path", F.posexplode(ref_names(F.col("code"))).alias("pos", "ref"))
    by_name = catalog.models_by_name().select(F.col("name").alias("ref"),
                                              F.col("relation_name").alias("rel"))
    j = refs.join(by_name, "ref")
    return (j.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "rel")))
                                  .alias("r"))
            .select("path", F.transform("r", lambda x: x["ref"]).alias("upstream"),
                    _last_by_name("r", "ref", lambda x: x["rel"]).alias("upstream_tables")))


def model_diffs(changed: DataFrame, diffs: DataFrame) -> DataFrame:
    """Diff text per changed model — exact path for catalog models;
    for a new model the first diff (by path) whose path contains its name.

    Containment is an equi-join first: a name of ``GRAM`` characters or more
    meets the paths that hold its first ``GRAM`` characters anywhere, a shorter
    one those that hold all of it; the whole name is then confirmed.  A path
    gives one row per distinct piece of each length that names have."""
    known = (changed.filter(~F.col("is_new")).join(diffs, "path", "left")
             .select("name", "path", F.coalesce("diff", F.lit("")).alias("diff")))
    new = changed.filter(F.col("is_new")).select("name", "path", F.substring("name", 1, GRAM).alias("piece"))
    # at most GRAM lengths, so one row
    lengths = new.agg(F.collect_set(F.length("piece")).alias("k")).scalar()
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.length("dpath"), F.lit(1))))
    pieces = (diffs.select(F.col("path").alias("dpath")).withColumn("ks", lengths).select("dpath", "ks", starts.alias("s"))
              .select("dpath", "s", F.explode("ks").alias("k"))
              .select("dpath", F.expr("substring(dpath, s, k)").alias("piece")).distinct())
    first = (new.join(pieces, "piece").filter(F.col("dpath").contains(F.col("name")))
             .groupBy("name", "path").agg(F.min("dpath").alias("dpath")))
    texts = diffs.select(F.col("path").alias("dpath"), "diff")
    found = (changed.filter(F.col("is_new")).select("name", "path").join(first, ["name", "path"], "left")
             .join(texts, "dpath", "left").select("name", "path", F.coalesce("diff", F.lit("")).alias("diff")))
    return known.unionByName(found)


def prior_results(last_results: DataFrame | None) -> DataFrame | None:
    """``model, existing_results`` (check, status, detail) of the last
    review, in its order."""
    if last_results is None:
        return None
    r = last_results
    return (r.groupBy("model").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "check", "status", "detail"))),
        lambda x: F.struct(x["check"].alias("check"), x["status"].alias("status"),
                           x["detail"].alias("detail"))).alias("existing_results")))


def model_context(catalog: Catalog, changed_files: DataFrame | None, diffs: DataFrame,
                  new_code: DataFrame | None = None, last_results: DataFrame | None = None,
                  schema_map: dict | None = None, models: list[str] | None = None) -> DataFrame:
    """One row per model — name, relation (mapped), diff, code, columns,
    upstream names and tables, downstream names, prior results, ``is_new``.
    The models are the changed ones or, with ``models``, those named, changed
    or not (unknown names have no row)."""
    spark = catalog.models.sparkSession
    if models is not None:
        changed = catalog.models_by_name().filter(F.col("name").isin(list(models))).select(
            F.col("original_file_path").alias("path"), "name", "unique_id", F.lit(False).alias("is_new"))
    else:
        changed = changed_models(catalog, changed_files)
    dif = model_diffs(changed, diffs)
    nb = neighbors(catalog, schema_map)
    m = catalog.models.select("unique_id", "relation_name", "raw_code", "columns")
    known = (changed.filter(~F.col("is_new")).join(m, "unique_id").join(nb, "unique_id", "left")
             .select("path", "name",
                     map_relation_col(F.col("relation_name"), schema_map).alias("relation_name"),
                     F.col("raw_code"), "columns",
                     F.coalesce("upstream", F.array().cast("array<string>")).alias("upstream"),
                     F.coalesce("upstream_tables", F.create_map().cast("map<string,string>"))
                      .alias("upstream_tables"),
                     F.coalesce("downstream", F.array().cast("array<string>")).alias("downstream"),
                     F.lit(False).alias("is_new")))
    code = new_code if new_code is not None else spark.createDataFrame([], "path string, code string")
    refs = new_model_refs(catalog, code)
    new = (changed.filter(F.col("is_new")).join(code, "path", "left").join(refs, "path", "left")
           .select("path", "name", F.lit(NEW_RELATION).alias("relation_name"),
                   F.coalesce("code", F.lit("")).alias("raw_code"),
                   F.array().cast("array<string>").alias("columns"),
                   F.coalesce("upstream", F.array().cast("array<string>")).alias("upstream"),
                   F.coalesce(F.transform_values("upstream_tables", lambda k, v:
                                                 map_relation_col(v, schema_map)),
                              F.create_map().cast("map<string,string>")).alias("upstream_tables"),
                   F.array().cast("array<string>").alias("downstream"),
                   F.lit(True).alias("is_new")))
    out = known.unionByName(new).join(dif.select("name", "path", "diff"), ["name", "path"], "left")
    pr = prior_results(last_results)
    empty = F.array().cast("array<struct<check:string,status:string,detail:string>>")
    if pr is not None:
        out = out.join(pr.withColumnRenamed("model", "name"), "name", "left")
        out = out.withColumn("existing_results", F.coalesce("existing_results", empty))
    else:
        out = out.withColumn("existing_results", empty)
    return out.withColumn("diff", F.coalesce("diff", F.lit("")))


def status(catalog: Catalog, changed_files: DataFrame, last_summary: dict | None = None,
           max_depth: int = 10) -> dict:
    """Counts of models and tests, changed model names (new ones by
    file stem), blast radius names and the last review's summary line.
    Returns small driver values; the work is Spark jobs."""
    changed = changed_models(catalog, changed_files).orderBy("path")
    rows = changed.collect()
    names = [r["name"] for r in rows]
    ids = [r["unique_id"] for r in rows if r["unique_id"]]
    blast = []
    if ids:
        reach = blast_radius(catalog.edges, ids, max_depth)
        blast = [r["name"] for r in reached_models(catalog, reach).orderBy("unique_id").collect()]
    summary = None
    if last_summary is not None:
        s = last_summary
        summary = f"{s.get('fail', 0)} FAIL / {s.get('warn', 0)} WARN / {s.get('pass', 0)} PASS"
        if s.get("timestamp"):
            summary += f" ({s['timestamp']})"
    return {
        "models": catalog.model_count().collect()[0][0],
        "tests": catalog.test_count().collect()[0][0],
        "changed_models": names,
        "blast_radius": blast,
        "last_review_summary": summary,
    }
