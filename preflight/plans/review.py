"""R1 — the review: models → blast radius → checks → grade → samples.

Planning happens on the driver over catalog metadata.  Every table is read
once: row counts, NULL rates, duplicate keys and value domains are observed
on its ``GROUPING SETS`` aggregate, and the groups that others need - the keys
of foreign keys on either side, the values of listed columns - are written
once (``fused.TableGroups``) and read by all of them.  The key counts of all
foreign keys of like types are compared in one aggregation.  Summary and
sections are counted from the graded rows.

Errors are isolated.  Columns are resolved against the table's schema as
Spark resolves them; a missing one, or a check that cannot be planned, is a
FAIL row.  Each table is one action, all submitted together; if one fails,
its checks are halved until the failing ones stand alone (group testing), and
these become FAIL ``SQL error: …`` rows.

Samples of failing checks are a second action (≤ ``limit`` rows per check,
the samples' documented size), with one scan for all NULL samples of a table
and one for its duplicate keys; foreign keys are sampled from their groups.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preflight.config import MAX_GROUPING_SETS, ReviewOptions, Thresholds
from preflight.operators import checks as C
from preflight.operators import grade as G
from preflight.functions.columns import resolve_column
from preflight.operators.fused import FUSED, METRICS, TableReads, graded, listed_values
from preflight.plans.checks import CheckSpec, plan_checks
from preflight.sources.catalog import Catalog
from preflight.sources.tables import TableResolver

RESULT_SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("check", T.StringType()),
    T.StructField("importance", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("target", T.StringType()),
])
RESULT_COLUMNS = [f.name for f in RESULT_SCHEMA.fields]

SAMPLE_SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("check", T.StringType()),
    T.StructField("row_no", T.IntegerType()),
    T.StructField("row", T.StringType()),
])


def _target(spec: CheckSpec) -> str:
    return spec.parent if spec.check == "fk_match_rate" else (spec.column or "")


GRADED_SCHEMA = "ordinal int, status string, detail string"


def _graded(spec: CheckSpec, metrics: DataFrame, exprs: dict) -> DataFrame:
    """Grade and stamp in one projection."""
    return metrics.select(F.lit(spec.ordinal).alias("ordinal"),
                          exprs["status"].alias("status"), exprs["detail"].alias("detail"))


def spec_frame(spark: SparkSession, specs: list[CheckSpec]) -> DataFrame:
    return spark.createDataFrame(
        [(s.ordinal, s.model, s.category, s.check, s.importance, _target(s)) for s in specs],
        "ordinal int, model string, category string, check string, importance string, "
        "target string")


@dataclass
class BuiltCheck:
    spec: CheckSpec
    result: DataFrame | None = None   # graded: ordinal, status, detail (of all members)
    error: str | None = None
    members: list = field(default_factory=list)   # checks whose rows ``result`` holds
    alone: object = None              # () -> graded frame of this check only
    table: tuple | None = None        # (frame, schema, spec with resolved names)
    groups: TableReads | None = None          # of its table
    parent: tuple | None = None               # (frame, its groups)


def build_checks(spark: SparkSession, specs: list[CheckSpec], resolver: TableResolver,
                 thresholds: Thresholds = Thresholds(), sample_limit: int = 5,
                 threads: int = 8) -> list[BuiltCheck]:
    """Graded frames of ``specs``.

    Each relation is resolved once and, if a check or a foreign key needs it,
    read once (``TableGroups``); the tables' actions run together.  What is
    left lazy is the comparison of foreign keys over the groups.  Checks that
    fail on their own are planned alone, for ``run_checks`` to report."""
    from concurrent.futures import ThreadPoolExecutor

    relations = list(dict.fromkeys([s.relation for s in specs] +
                                   [s.parent_relation for s in specs if s.parent_relation]))

    def resolve(rel):
        try:
            df = resolver.resolve(rel)
            return rel, (df, df.schema)
        except Exception as e:  # noqa: BLE001 - reported as a check error
            return rel, e

    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        frames = dict(pool.map(resolve, relations))
        built = list(pool.map(lambda s: _build(s, frames, thresholds), specs))
        own = {r: [b.table[2] for b in built if b.error is None and b.spec.relation == r and b.spec.check in FUSED]
               for r in relations}
        keep = {r: [] for r in relations}
        for b in built:
            if b.error is None and b.spec.check == "fk_match_rate":
                keep[b.spec.relation].append(b.table[2].keys)
                keep[b.spec.parent_relation].append(b.table[2].parent_keys)
            elif b.error is None and b.spec.check in LISTED:
                keep[b.spec.relation].append((b.table[2].column,))

        def read(rel):
            if isinstance(frames[rel], Exception):
                return rel, None
            return rel, TableReads(*frames[rel], own[rel], keep[rel], MAX_GROUPING_SETS)
        groups = dict(pool.map(read, relations))
    metrics = [m for g in groups.values() if g for m in g.metrics]
    measured = {m[0] for m in metrics}
    together = graded(spark.createDataFrame(metrics, METRICS), thresholds) if metrics else None
    fks = []
    first = None
    for b in built:
        if b.error is not None:
            continue
        b.groups = groups[b.spec.relation]
        if b.spec.check == "fk_match_rate":
            b.parent = (frames[b.spec.parent_relation][0], groups[b.spec.parent_relation])
            if b.groups.has(b.table[2].keys) and b.parent[1].has(b.table[2].parent_keys):
                fks.append(b)
                continue
        elif b.spec.ordinal in measured:
            first = first or b
            first.result = together
            first.members.append(b.spec)
            continue
        try:
            b.result, b.members = b.alone(), [b.spec]
        except Exception as e:  # noqa: BLE001 - reported as this check's result
            b.error = _short(e)
    if fks:
        rates = C.fk_match_rates([(b.spec.ordinal, b.spec.parent, b.table[2].keys, b.groups.rows(b.table[2].keys),
                                   b.table[2].parent_keys, b.parent[1].rows(b.table[2].parent_keys)) for b in fks])
        grades = G.fk_exprs(thresholds)
        fks[0].result = rates.select(F.col("fk").alias("ordinal"), grades["status"].alias("status"),
                                     grades["detail"].alias("detail"))
        fks[0].members = [b.spec for b in fks]
    return built


#: Checks whose columns' values are listed (``Review.values``).
LISTED = ("value_distribution", "unexpected_values")


def _build(s: CheckSpec, frames: dict, thresholds: Thresholds) -> BuiltCheck:
    """The check with its table's names, or what is wrong with it."""
    try:
        for rel in (s.relation, s.parent_relation if s.check == "fk_match_rate" else None):
            if isinstance(frames.get(rel), Exception):
                raise frames[rel]
        df, schema = frames[s.relation]
        parent = frames.get(s.parent_relation) if s.check == "fk_match_rate" else None
        case_sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
        r = _resolved(s, schema, parent and parent[1], case_sensitive)
        alone = _alone(r, df, schema, parent and parent[0], thresholds)
        if s.check == "unexpected_values":
            alone()                              # plans, or raises
        return BuiltCheck(s, alone=alone, table=(df, schema, r))
    except Exception as e:  # noqa: BLE001 - reported as this check's result
        return BuiltCheck(s, error=e.args[0] if isinstance(e, KeyError) else _short(e))


def _resolved(s: CheckSpec, schema, parent_schema, case_sensitive: bool) -> CheckSpec:
    """``s`` with the names its tables have; a KeyError names what is missing."""
    def real(name, of, where):
        got = resolve_column(of.fieldNames(), name, case_sensitive)
        if got is None:
            raise KeyError(f"column {name} not found in {where}")
        return got
    change = {}
    if s.column:
        change["column"] = real(s.column, schema, s.relation)
    if s.keys:
        change["keys"] = tuple(real(c, schema, s.relation) for c in s.keys)
    if s.check == "fk_match_rate":
        change["parent_keys"] = tuple(real(c, parent_schema, s.parent_relation) for c in s.parent_keys)
    if s.sample_columns:
        found = [resolve_column(schema.fieldNames(), c, case_sensitive) for c in s.sample_columns]
        change["sample_columns"] = tuple(c for c in found if c)
    return replace(s, **change)


def _graded_fk(s, df, parent, thresholds) -> DataFrame:
    m = C.fk_match_rate(df, parent, list(s.keys), s.parent, parent_keys=list(s.parent_keys))
    return _graded(s, m, G.fk_exprs(thresholds))


def _alone(s: CheckSpec, df, schema, parent, thresholds):
    """The check on its own, from the standalone operators."""
    def build() -> DataFrame:
        if s.check == "fk_match_rate":
            return _graded_fk(s, df, parent, thresholds)
        if s.check == "unexpected_values":
            m = G.grade_unexpected_values(C.unexpected_values(
                df, s.column, s.accepted or (), None, schema[s.column].dataType))
        elif s.check == "null_rate":
            m = G.grade_null_rate(C.null_rate(df, s.column), thresholds)
        elif s.check == "pk_duplicates":
            m = G.grade_pk_duplicates(C.pk_duplicates(df, s.column))
        elif s.check == "value_distribution":
            m = G.grade_value_distribution(C.value_groups(df, s.column), s.column)
        elif s.check == "row_count":
            m = G.grade_row_count(C.row_count(df))
        else:
            m = G.grade_rows_returned(df)
        return m.select(F.lit(s.ordinal).alias("ordinal"), "status", "detail")
    return build


def value_frame(spark: SparkSession, built: list[BuiltCheck]) -> DataFrame:
    """``model, column_name, value, row_count, unexpected``: every value of the
    columns with accepted values, from the tables' groups; nothing cut."""
    parts, columns = [], {}
    for b in built:
        if b.error is None and b.spec.check in LISTED and b.table:
            key = (b.spec.model, b.spec.relation, b.table[2].column)
            if b.spec.check == "unexpected_values":
                columns[key] = (b, tuple(b.table[2].accepted or ()))
            else:
                columns.setdefault(key, (b, None))
    for (model, _, c), (b, accepted) in columns.items():
        df, schema, _ = b.table
        rows = b.groups.rows((c,)) if b.groups.has((c,)) else C.key_groups(df, c).withColumnRenamed("occurrences", "n")
        parts.append(listed_values(rows, c, accepted, schema[c].dataType).select(F.lit(model).alias("model"), "*"))
    if not parts:
        return spark.createDataFrame([], "model string, column_name string, value string, row_count long, "
                                         "unexpected boolean")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graded_frame(spark: SparkSession, built: list[BuiltCheck]) -> DataFrame:
    """``ordinal, status, detail`` of all checks (errors as literal rows)."""
    errors = [(b.spec.ordinal, "FAIL", f"SQL error: {b.error}") for b in built
              if b.error is not None]
    parts = [b.result for b in built if b.error is None and b.result is not None]
    if errors or not parts:
        parts.append(spark.createDataFrame(errors, GRADED_SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def results_frame(spark: SparkSession, built: list[BuiltCheck]) -> DataFrame:
    """All graded checks as one lazy frame in ``RESULT_SCHEMA``.  The check
    descriptions are a driver-built table with one row per check (its size
    is the number of checks, known before planning), broadcast into the
    join."""
    meta = spec_frame(spark, [b.spec for b in built])
    return (graded_frame(spark, built).join(F.broadcast(meta), "ordinal")
            .select(*RESULT_COLUMNS))


def _short(e: Exception) -> str:
    msg = str(e).strip().splitlines()
    return msg[0] if msg else type(e).__name__


def run_checks(spark: SparkSession, built: list[BuiltCheck], threads: int = 8) -> list:
    """One action for each table, submitted together; of a failing one, only
    its checks run again, each on its own (E8)."""
    from concurrent.futures import ThreadPoolExecutor

    by_ordinal = {b.spec.ordinal: b for b in built}

    def failed(s, e):
        return (s.ordinal, "FAIL", f"SQL error: {e if isinstance(e, str) else _short(e)}")

    def run(b):
        if b.error is not None:
            return [failed(b.spec, b.error)]
        if b.result is None:
            return []
        try:
            return [tuple(r) for r in b.result.collect()]
        except Exception:  # noqa: BLE001 - find the failing checks
            out = []
            for s in b.members:
                try:
                    out += [tuple(r) for r in by_ordinal[s.ordinal].alone().collect()]
                except Exception as e:  # noqa: BLE001
                    out.append(failed(s, e))
            return out

    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        rows = [r for part in pool.map(run, built) for r in part]
    out = []
    for o, st, de in rows:
        s = by_ordinal[o].spec
        out.append({"ordinal": o, "model": s.model, "category": s.category, "check": s.check,
                    "importance": s.importance, "status": st, "detail": de, "target": _target(s)})
    return out


def sample_frame(spark: SparkSession, built: list[BuiltCheck], failing: set[int], limit: int = 5) -> DataFrame:
    """Rows of the failing checks' samples as JSON text, numbered: one scan
    of a table for all its NULL samples, one for its duplicate keys; unmatched
    keys come from the groups."""
    todo = [b for b in built if b.spec.ordinal in failing and b.error is None and b.table]
    parts = []
    for kind, sample in (("null_rate", C.null_samples), ("pk_duplicates", C.pk_samples)):
        by_table: dict = {}
        for b in todo:
            if b.spec.check == kind:
                by_table.setdefault(b.spec.relation, []).append(b)
        for members in by_table.values():
            df = members[0].table[0]
            checks = {b.spec.ordinal: (b.table[2].column, list(b.table[2].sample_columns or df.columns)) for b in members}
            parts.append(sample(df, checks, limit))
    for b in todo:
        if b.spec.check == "fk_match_rate":
            df, _, r = b.table
            frame, pgroups = b.parent
            j = C.fk_groups(df, frame, list(r.keys), list(r.parent_keys),
                            b.groups.rows(r.keys) if b.groups.has(r.keys) else None,
                            pgroups.rows(r.parent_keys) if pgroups.has(r.parent_keys) else None)
            s = C.fk_sample(df, frame, list(r.keys), j, limit)
            order = [F.col("unmatched_rows").desc(), *[C.qcol(k).asc_nulls_first() for k in r.keys]]
            # at most ``limit`` rows, so one task is enough
            parts.append(s.select(F.lit(b.spec.ordinal).alias("ordinal"),
                                  (F.row_number().over(Window.orderBy(*order)) - 1).alias("row_no"),
                                  F.to_json(F.struct(*[C.qcol(c) for c in s.columns])).alias("row")))
    if not parts:
        return spark.createDataFrame([], SAMPLE_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(F.broadcast(spec_frame(spark, [b.spec for b in todo])), "ordinal").select(
        *[F.col(f.name).cast(f.dataType) for f in SAMPLE_SCHEMA.fields])


def collect_samples(spark: SparkSession, built: list[BuiltCheck], failing: set[int], limit: int = 5) -> list:
    """Samples only for WARN/FAIL checks; sampling errors swallowed."""
    try:
        rows = sample_frame(spark, built, failing, limit).collect()
    except Exception:  # noqa: BLE001
        rows = []
        for b in built:
            if b.spec.ordinal in failing:
                try:
                    rows += sample_frame(spark, [b], {b.spec.ordinal}, limit).collect()
                except Exception:  # noqa: BLE001
                    pass
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[3]))


@dataclass
class Review:
    results: DataFrame
    samples: DataFrame
    summary: dict
    models_reviewed: list
    blast_radius: list
    duration_seconds: float
    checks: list = field(default_factory=list)
    values: DataFrame | None = None   # every value of the columns with accepted values

    def release(self) -> None:
        """Delete the tables' groups, once ``values`` is stored or not needed."""
        for reads in {id(g): g for b in self.checks for g in (b.groups, b.parent and b.parent[1]) if g}.values():
            reads.release()

    def unexpected_values(self) -> DataFrame:
        """The unexpected ones of ``values``."""
        return self.values.filter("unexpected").drop("unexpected")


def summarize(rows) -> dict:
    """FAIL / WARN / PASS counts (SKIP and others not counted)."""
    out = {"fail": 0, "warn": 0, "pass": 0}
    for r in rows:
        k = str(r["status"]).lower()
        if k in out:
            out[k] += 1
    return out


def resolve_models(catalog: Catalog, models=None, changed_files: DataFrame | None = None):
    """Names to review, the ids the blast radius starts from and the model
    rows found (``{name: row}``).

    Named models stay listed even when unknown (they simply get no
    checks); changed files not in the catalog are skipped."""
    from preflight.plans.context import changed_models
    if models:
        names = list(models)
        found = (catalog.models_by_name().filter(F.col("name").isin(list(set(names))))
                 .collect())
        by = {r["name"]: r for r in found}
        ids = [by[n]["unique_id"] for n in names if n in by]
        return names, list(dict.fromkeys(ids)), by
    if changed_files is None:
        return [], [], None
    rows = (changed_models(catalog, changed_files).filter(~F.col("is_new"))
            .orderBy("path").collect())
    return ([r["name"] for r in rows], list(dict.fromkeys(r["unique_id"] for r in rows)),
            None)


def review(spark: SparkSession, catalog: Catalog, resolver: TableResolver, models=None,
           changed_files: DataFrame | None = None,
           options: ReviewOptions = ReviewOptions()) -> Review:
    from preflight.operators.lineage import blast_radius, reached_models

    start = time.time()
    names, seeds, found = resolve_models(catalog, models, changed_files)
    if not names:
        raise ValueError("No models to review. Name models or pass changed files "
                         "that match catalog models.")
    blast = []
    if seeds:
        reach = blast_radius(catalog.edges, seeds, options.max_depth)
        blast = [r["name"] for r in reached_models(catalog, reach).orderBy("unique_id").collect()]
    specs = plan_checks(catalog, names, options.categories, options.join_keys, found)
    if options.schema_map:
        resolver = resolver.mapped(options.schema_map)
    if options.dry_run:
        rows = [(s.ordinal, s.model, s.category, s.check, s.importance, "SKIP",
                 "Skipped (dry-run mode)", _target(s)) for s in specs]
        built, samples = [], []
    else:
        built = build_checks(spark, specs, resolver, options.thresholds, options.sample_limit)
        rows = [tuple(r[c] for c in RESULT_COLUMNS) for r in run_checks(spark, built)]
        failing = {r[0] for r in rows if r[5] in ("FAIL", "WARN")}
        samples = collect_samples(spark, built, failing, options.sample_limit)
    rows.sort(key=lambda r: r[0])
    results = spark.createDataFrame(rows, RESULT_SCHEMA)
    sample_df = spark.createDataFrame(samples, SAMPLE_SCHEMA)
    summary = summarize([{"status": r[5]} for r in rows])
    return Review(results, sample_df, summary, names, blast,
                  round(time.time() - start, 1), built, value_frame(spark, built))
