"""Command line: ``python -m preflight <review|checks|status|context|edge-cases|verdicts> …``.

    python -m preflight review --manifest target/manifest.json \
        --tables /warehouse/parquet --models fact_orders --out out/
    python -m preflight checks --manifest … --models fact_orders     # dry run
    python -m preflight status --manifest … --changed-files changed.txt --out out/
    python -m preflight context --manifest … --changed-files changed.txt --diff change.diff --project . --out out/
    python -m preflight edge-cases --tables … --cases cases.json --out out/
    python -m preflight verdicts --verdicts verdicts.json --out out/

``--changed-files`` is a text file with one path per line (the output of a
version-control diff); ``--tables`` is a folder of ``<table>.parquet``;
relations not found there are looked up in the session catalog.  ``--out`` also
names the stored review that ``status`` and ``context`` report.  ``--diff`` is the
diff's text, ``--project`` the folder of the changed files (new models' code).  ``--cases`` is a JSON list of
``model, description, risk, sql[, sample_sql]`` whose SQL names tables as
``{table}``; ``--verdicts`` one of ``index, verdict, status``.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from preflight.config import ReviewOptions, Thresholds


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="preflight")
    p.add_argument("command", choices=["review", "checks", "status", "context", "edge-cases", "verdicts"])
    p.add_argument("--manifest", help="manifest.json file(s) or folder")
    p.add_argument("--tables", help="folder of <table>.parquet")
    p.add_argument("--models", help="comma-separated model names")
    p.add_argument("--changed-files", help="text file, one changed path per line")
    p.add_argument("--categories", help="comma-separated: grain,distribution,join,rowcount")
    p.add_argument("--schema-map", help='JSON object {"old": "new"} for relation names')
    p.add_argument("--join-keys", help='JSON object {child: {parent: [columns or [child, parent] pairs]}}')
    p.add_argument("--thresholds", help='JSON object, e.g. {"null_rate_fail": 0.1}')
    p.add_argument("--cases", help="edge cases, a JSON file")
    p.add_argument("--diff", help="text of a unified diff, a file")
    p.add_argument("--project", help="folder that the changed paths are relative to")
    p.add_argument("--verdicts", help="verdicts, a JSON file")
    p.add_argument("--out", help="folder for compare.csv and review.json")
    p.add_argument("--master", default=None)
    return p


def _join_keys(text: str | None) -> dict:
    return {child: {parent: [tuple(k) if isinstance(k, list) else k for k in keys] for parent, keys in parents.items()}
            for child, parents in json.loads(text or "{}").items()}


def _edge_cases(spark, a) -> int:
    import re

    from preflight.operators.edge_cases import EdgeCase, edge_case_totals, run_edge_cases
    from preflight.sources import sinks
    from preflight.sources.tables import TableResolver

    with open(a.cases) as f:
        cases = [EdgeCase(c["model"], c["description"], c["risk"], c["sql"], sample_sql=c.get("sample_sql"))
                 for c in json.load(f)]
    resolver = TableResolver(spark, parquet_dir=a.tables)
    names = {n for c in cases for n in re.findall(r"\{(\w+)\}", f"{c.sql} {c.sample_sql or ''}")}
    run = run_edge_cases(spark, cases, {n: resolver.resolve(n) for n in sorted(names)})
    if a.out:
        sinks.write_edge_cases(run, os.path.join(a.out, "edge_cases"))
    t = edge_case_totals(run.results).first()
    print(json.dumps({"edge_cases_run": t["edge_cases_run"], "flagged": t["flagged"] or 0,
                      "results": [r.asDict() for r in run.results.orderBy("index").collect()]}))
    return 0


def _verdicts(spark, a) -> int:
    from preflight.sources import sinks

    with open(a.verdicts) as f:
        rows = [(v["index"], v["verdict"], v["status"], i) for i, v in enumerate(json.load(f))]
    frame = spark.createDataFrame(rows, "index long, verdict string, status string, ordinal long")
    at = os.path.join(a.out, "edge_cases")
    print(json.dumps(sinks.interpret(spark, at, frame)))
    return 0


def _context(spark, a, catalog, changed, schema_map) -> int:
    """What a reviewer needs to know of each changed or named model."""
    from preflight.plans.context import model_context
    from preflight.sources import sinks
    from preflight.sources.changes import diff_lines, split_diffs

    if a.diff:
        diffs = split_diffs(diff_lines(spark, a.diff)).drop("diff_id")
    else:
        diffs = spark.createDataFrame([], "path string, diff string")
    code = None
    if a.project and changed is not None:
        rows = [r["path"] for r in changed.collect() if os.path.isfile(os.path.join(a.project, r["path"]))]
        code = spark.createDataFrame([(p, open(os.path.join(a.project, p)).read()) for p in rows],
                                     "path string, code string")
    doc = sinks.load_review(spark, os.path.join(a.out, "review")) if a.out else None
    out = model_context(catalog, changed, diffs, code, sinks.review_results(doc) if doc is not None else None,
                        schema_map, a.models.split(",") if a.models else None)
    print(json.dumps([r.asDict(recursive=True) for r in out.orderBy("name", "path").collect()]))
    return 0


def main(argv=None) -> int:
    a = _parser().parse_args(argv)
    from preflight.plans.checks import plan_checks, preview
    from preflight.plans.context import status
    from preflight.plans.review import review
    from preflight.session import get_spark
    from preflight.sources import sinks
    from preflight.sources.catalog import load_manifest
    from preflight.sources.tables import TableResolver

    spark = get_spark(a.master)
    if a.command == "edge-cases":
        return _edge_cases(spark, a)
    if a.command == "verdicts":
        return _verdicts(spark, a)
    catalog = load_manifest(spark, a.manifest.split(","))
    changed = None
    if a.changed_files:
        with open(a.changed_files) as f:
            paths = [line.strip() for line in f if line.strip()]
        changed = spark.createDataFrame([(x,) for x in paths], "path string")
    schema_map = json.loads(a.schema_map) if a.schema_map else {}
    if a.command == "status":
        if changed is None:
            changed = spark.createDataFrame([], "path string")
        last = sinks.last_summary(spark, os.path.join(a.out, "review")) if a.out else None
        print(json.dumps(status(catalog, changed, last)))
        return 0
    if a.command == "context":
        return _context(spark, a, catalog, changed, schema_map)
    models = a.models.split(",") if a.models else None
    cats = tuple(a.categories.split(",")) if a.categories else None
    opts = ReviewOptions(categories=cats, schema_map=schema_map, dry_run=a.command == "checks",
                         join_keys=_join_keys(a.join_keys),
                         thresholds=Thresholds(**json.loads(a.thresholds or "{}")))
    resolver = TableResolver(spark, parquet_dir=a.tables)
    try:
        rv = review(spark, catalog, resolver, models=models, changed_files=changed, options=opts)
    except ValueError as e:
        print(json.dumps({"error": str(e)}))
        return 2
    shown = rv.results
    if a.command == "checks":
        names = models or rv.models_reviewed
        shown = preview(spark, plan_checks(catalog, names, cats, opts.join_keys))
    rows = [r.asDict() for r in shown.orderBy("ordinal").collect()]
    if a.out:
        sinks.write_report(rv.results, os.path.join(a.out, "compare"))
        sinks.write_review(rv, os.path.join(a.out, "review"))
    rv.release()
    print(json.dumps({"summary": rv.summary, "models_reviewed": rv.models_reviewed,
                      "blast_radius": rv.blast_radius, "duration_seconds": rv.duration_seconds,
                      "results": rows}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
