"""From catalog rules to planned checks (metadata only, no table data).

``join_keys`` (J3) is a DataFrame job over the catalog; ``plan_checks``
collects the rule rows of the *requested* models — metadata whose size is
the number of declared tests, never table rows — into ``CheckSpec``s in
model → category → test order (U1).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preflight.config import CATEGORIES
from preflight.functions.columns import sample_columns
from preflight.sources.catalog import Catalog


@dataclass(frozen=True)
class CheckSpec:
    ordinal: int
    category: str
    model: str
    check: str
    importance: str
    relation: str
    column: str | None = None
    accepted: tuple | None = None
    parent: str | None = None
    parent_relation: str | None = None
    keys: tuple = ()            # child key columns
    parent_keys: tuple = ()     # parent key columns (same names unless overridden)
    sample_columns: tuple = ()
    model_columns: tuple = field(default=(), compare=False)


def join_keys(catalog: Catalog, overrides: dict | None = None,
              child_ids: list[str] | None = None) -> DataFrame:
    """``child, parent, child_keys, parent_keys`` per (model, parent
    model it depends on).  Keys are the override for (child, parent) when
    given and non-empty, else every unique-tested column of the parent that
    the child also has (exact name).  Pairs without keys are dropped.

    An override entry is a column name or a ``(child_col, parent_col)``
    pair.  ``child_ids`` restricts the children (a filter on the catalog
    frame, applied before any join)."""
    spark = catalog.models.sparkSession
    m = catalog.models
    if child_ids is not None:
        m_child = m.filter(F.col("unique_id").isin(list(child_ids)))
    else:
        m_child = m
    child = m_child.select(F.col("unique_id").alias("child_id"), F.col("name").alias("child"),
                           F.col("columns").alias("child_columns"),
                           F.posexplode("depends_on").alias("dep_pos", "parent_id"))
    parent = m.select(F.col("unique_id").alias("parent_id"), F.col("name").alias("parent"))
    pairs = child.join(parent, "parent_id")
    uniq = catalog.rules_of("unique").select(
        F.col("model_id").alias("parent_id"), "column", "ordinal")
    inferred = (pairs.join(uniq, "parent_id")
                .filter(F.array_contains("child_columns", F.col("column")))
                .groupBy("child_id", "parent_id")
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))),
                                 lambda x: x["column"]).alias("inferred")))
    orows = []
    for c, parents in (overrides or {}).items():
        for p, keys in (parents or {}).items():
            if keys:
                ck = [k[0] if isinstance(k, (list, tuple)) else k for k in keys]
                pk = [k[1] if isinstance(k, (list, tuple)) else k for k in keys]
                orows.append((c, p, ck, pk))
    ov = spark.createDataFrame(
        orows, "child string, parent string, o_child array<string>, o_parent array<string>")
    out = (pairs.join(inferred, ["child_id", "parent_id"], "left")
           .join(ov, ["child", "parent"], "left")
           .select("child", "parent", "child_id", "parent_id", "dep_pos",
                   F.coalesce("o_child", "inferred").alias("child_keys"),
                   F.coalesce("o_parent", "inferred").alias("parent_keys"))
           .filter(F.size(F.coalesce("child_keys", F.array())) > 0))
    return out


def plan_checks(catalog: Catalog, model_names: list[str],
                categories=None, overrides: dict | None = None,
                resolved: dict | None = None) -> list[CheckSpec]:
    """Checks for the named models (unknown names skipped, repeats kept).
    ``categories`` None = all four, [] = none; unknown names ignored.
    ``resolved`` ({name: model row}) skips the lookup by name."""
    cats = list(CATEGORIES) if categories is None else [c for c in categories]
    if not model_names or not cats:
        return []
    from concurrent.futures import ThreadPoolExecutor

    names = list(dict.fromkeys(model_names))
    if resolved is not None:      # model rows already looked up by name
        models = {k: v for k, v in resolved.items() if k in names}
    else:
        models = {r["name"]: r for r in
                  catalog.models_by_name().filter(F.col("name").isin(names)).collect()}
    if not models:
        return []
    ids = [r["unique_id"] for r in models.values()]
    rules_q = catalog.rules.filter(F.col("model_id").isin(ids))
    rel = catalog.models.select(F.col("unique_id").alias("parent_id"),
                                F.col("relation_name").alias("parent_relation"))
    fk_q = join_keys(catalog, overrides, ids).join(rel, "parent_id")
    # two small catalog lookups (metadata of the requested models) in
    # parallel; their rows are sorted here (a distributed sort of a few
    # rows would cost a sampling job)
    jobs = [rules_q] + ([fk_q] if "join" in cats else [])
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        got = list(pool.map(lambda q: q.collect(), jobs))
    rules_by: dict[str, list] = {}
    for r in sorted(got[0], key=lambda r: (r["model_id"], r["ordinal"])):
        rules_by.setdefault(r["model_id"], []).append(r)
    fks: dict[str, list] = {}
    for r in sorted(got[1] if len(got) > 1 else [], key=lambda r: (r["child_id"], r["dep_pos"])):
        fks.setdefault(r["child_id"], []).append(r)

    specs: list[CheckSpec] = []

    def add(**kw):
        specs.append(CheckSpec(ordinal=len(specs), **kw))

    for name in model_names:
        meta = models.get(name)
        if meta is None:
            continue
        uid, rel, cols = meta["unique_id"], meta["relation_name"], tuple(meta["columns"] or ())
        rules = rules_by.get(uid, [])
        base = dict(model=name, relation=rel, model_columns=cols)
        if "grain" in cats:
            for r in rules:
                if r["rule"] == "unique":
                    add(category="grain", check="pk_duplicates", importance="TIER0",
                        column=r["column"], **base)
            for r in rules:
                if r["rule"] == "not_null":
                    add(category="grain", check="null_rate", importance="HIGH",
                        column=r["column"],
                        sample_columns=tuple(sample_columns(list(cols), r["column"])), **base)
        if "distribution" in cats:
            for r in rules:
                if r["rule"] == "accepted_values":
                    acc = tuple(r["accepted_values"] or ())
                    add(category="distribution", check="value_distribution",
                        importance="NORMAL", column=r["column"], accepted=acc, **base)
                    add(category="distribution", check="unexpected_values",
                        importance="HIGH", column=r["column"], accepted=acc, **base)
        if "join" in cats:
            for r in fks.get(uid, []):
                add(category="join", check="fk_match_rate", importance="NORMAL",
                    parent=r["parent"], parent_relation=r["parent_relation"],
                    keys=tuple(r["child_keys"]), parent_keys=tuple(r["parent_keys"]), **base)
        if "rowcount" in cats:
            add(category="rowcount", check="row_count", importance="NORMAL", **base)
    return specs


#: Checks of which a failing one shows rows.
SAMPLED = ("pk_duplicates", "null_rate", "fk_match_rate")


def preview(spark: SparkSession, specs: list[CheckSpec]) -> DataFrame:
    """The planned checks as rows, each marked SKIP, and whether a
    failing one would show a sample."""
    rows = [(s.ordinal, s.model, s.category, s.check, s.importance, "SKIP",
             "Skipped (dry-run mode)", s.column or s.parent or "", s.relation, s.check in SAMPLED)
            for s in specs]
    return spark.createDataFrame(
        rows, "ordinal int, model string, category string, check string, "
              "importance string, status string, detail string, target string, "
              "relation string, has_sample boolean")
