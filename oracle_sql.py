"""Plain-SQL statements of the checks, for the DuckDB cross-check.

These are written the way a warehouse check is written by hand —
``COUNT(*) - COUNT(DISTINCT col)``, a plain ``LEFT JOIN`` for foreign keys,
``NOT IN`` for accepted values — so they check the Spark plans (which
pre-group, fuse and reuse) against the direct definitions.
"""

from __future__ import annotations

from preflight.plans import demo_catalog as D


def fmt_int(e: str) -> str:
    return f"format('{{:,}}', CAST({e} AS BIGINT))"


def pct_txt(e: str, scale: int) -> str:
    return (f"regexp_replace(regexp_replace(CAST(CAST({e} AS DECIMAL(30,{scale})) AS VARCHAR),"
            f" '0+$', ''), '\\.$', '.0')")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def head(ordinal, model, category, check, importance, target) -> str:
    return (f"CAST({ordinal} AS INTEGER) AS ordinal, {q(model)} AS model, {q(category)} AS category, "
            f"{q(check)} AS \"check\", {q(importance)} AS importance")


def pk_sql(ordinal, model, table, col) -> str:
    return (f"SELECT {head(ordinal, model, 'grain', 'pk_duplicates', 'TIER0', col)}, "
            f"CASE WHEN d > 0 THEN 'FAIL' ELSE 'PASS' END AS status, "
            f"{fmt_int('d')} || ' duplicate {col} values out of ' || {fmt_int('t')} || ' rows' AS detail, "
            f"{q(col)} AS target "
            f"FROM (SELECT COUNT(*) AS t, COUNT(*) - COUNT(DISTINCT {col}) AS d FROM {table})")


def null_sql(ordinal, model, table, col, fail=0.05, warn=0.001) -> str:
    return (f"SELECT {head(ordinal, model, 'grain', 'null_rate', 'HIGH', col)}, "
            f"CASE WHEN p IS NULL THEN 'FAIL' WHEN p / 100.0 > {fail} THEN 'FAIL' "
            f"WHEN p / 100.0 > {warn} THEN 'WARN' ELSE 'PASS' END AS status, "
            f"CASE WHEN p IS NULL THEN 'no rows' ELSE {fmt_int('n')} || ' nulls in {col} (' || "
            f"{pct_txt('p', 4)} || '%) out of ' || {fmt_int('t')} || ' rows' END AS detail, "
            f"{q(col)} AS target "
            f"FROM (SELECT t, n, ROUND(n * 100.0 / NULLIF(t, 0), 4) AS p FROM "
            f"(SELECT COUNT(*) AS t, SUM(CASE WHEN {col} IS NULL THEN 1 ELSE 0 END) AS n FROM {table}))")


def dist_sql(ordinal, model, table, col) -> str:
    return (f"SELECT {head(ordinal, model, 'distribution', 'value_distribution', 'NORMAL', col)}, "
            f"'PASS' AS status, CAST(k AS VARCHAR) || ' distinct values in {col}' AS detail, "
            f"{q(col)} AS target "
            f"FROM (SELECT COUNT(*) AS k FROM (SELECT {col} FROM {table} GROUP BY {col}))")


def accepted_list(values, sql_type: str | None) -> str:
    if sql_type is None:
        return ", ".join(q(str(v)) for v in values)
    items = " UNION ALL ".join(f"SELECT TRY_CAST({q(str(v))} AS {sql_type}) AS x" for v in values)
    return f"SELECT x FROM ({items}) WHERE x IS NOT NULL"


def unexpected_sql(ordinal, model, table, col, values, sql_type=None) -> str:
    return (f"SELECT {head(ordinal, model, 'distribution', 'unexpected_values', 'HIGH', col)}, "
            f"CASE WHEN k = 0 THEN 'PASS' ELSE 'WARN' END AS status, "
            f"CASE WHEN k = 0 THEN 'No unexpected values found' ELSE {fmt_int('k')} || "
            f"' unexpected value(s) in ' || {fmt_int('r')} || ' rows' END AS detail, {q(col)} AS target "
            f"FROM (SELECT COUNT(*) AS k, coalesce(SUM(n), 0) AS r FROM "
            f"(SELECT {col} AS v, COUNT(*) AS n FROM {table} WHERE {col} NOT IN "
            f"({accepted_list(values, sql_type)}) AND {col} IS NOT NULL GROUP BY {col}))")


def fk_sql(ordinal, model, child, parent_name, parent, keys, pkeys,
           fail=0.95, warn=0.99) -> str:
    cond = " AND ".join(f"c.{k} = p.{pk}" for k, pk in zip(keys, pkeys))
    return (f"SELECT {head(ordinal, model, 'join', 'fk_match_rate', 'NORMAL', parent_name)}, "
            f"CASE WHEN p IS NULL THEN 'FAIL' WHEN p / 100.0 < {fail} THEN 'FAIL' "
            f"WHEN p / 100.0 < {warn} THEN 'WARN' ELSE 'PASS' END AS status, "
            f"CASE WHEN p IS NULL THEN 'no rows' ELSE {fmt_int('m')} || '/' || {fmt_int('c')} || "
            f"' rows match {parent_name} (' || {pct_txt('p', 2)} || '%)' END AS detail, "
            f"{q(parent_name)} AS target "
            f"FROM (SELECT c, m, ROUND(m * 100.0 / NULLIF(c, 0), 2) AS p FROM "
            f"(SELECT COUNT(*) AS c, SUM(CASE WHEN p.{pkeys[0]} IS NOT NULL THEN 1 ELSE 0 END) AS m "
            f"FROM {child} c LEFT JOIN {parent} p ON {cond}))")


def rowcount_sql(ordinal, model, table) -> str:
    return (f"SELECT {head(ordinal, model, 'rowcount', 'row_count', 'NORMAL', '')}, "
            f"CASE WHEN n = 0 THEN 'FAIL' ELSE 'PASS' END AS status, "
            f"{fmt_int('n')} || ' rows' AS detail, '' AS target "
            f"FROM (SELECT COUNT(*) AS n FROM {table})")


def demo_review_sql() -> str:
    """Every check of the declared catalog in review order, UNION ALL."""
    parts, k = [], 0
    rules = D.RULES
    models = {m[0]: m for m in D.MODELS}
    uniques = {}
    for r in rules:
        if r[1] == "unique":
            uniques.setdefault(r[0], []).append(r[2])
    for name, cols, deps in D.MODELS:
        t = name
        mine = [r for r in rules if r[0] == name]
        for r in mine:
            if r[1] == "unique":
                parts.append(pk_sql(k, name, t, r[2])); k += 1
        for r in mine:
            if r[1] == "not_null":
                parts.append(null_sql(k, name, t, r[2])); k += 1
        last = {}
        for r in mine:
            if r[1] == "accepted_values":
                last[r[2]] = r
        seen = set()
        for r in mine:
            if r[1] == "accepted_values" and r[2] not in seen:
                seen.add(r[2])                 # the last rule's values at the first one's place
                r = last[r[2]]
                parts.append(dist_sql(k, name, t, r[2])); k += 1
                parts.append(unexpected_sql(k, name, t, r[2], r[3],
                                            D.ACCEPTED_TYPES.get((name, r[2])))); k += 1
        for dep in deps:
            over = D.JOIN_KEYS.get(name, {}).get(dep)
            if over:
                keys, pkeys = [a for a, _ in over], [b for _, b in over]
            else:
                keys = [c for c in uniques.get(dep, []) if c in cols]
                pkeys = keys
            if keys and dep in models:
                parts.append(fk_sql(k, name, t, dep, dep, keys, pkeys)); k += 1
        parts.append(rowcount_sql(k, name, t)); k += 1
    return "\nUNION ALL\n".join(parts)


def demo_charts_sql() -> str:
    parts = []
    for r in D.RULES:
        if r[1] == "accepted_values":
            parts.append(f"SELECT '{r[0]}.{r[2]}' AS title, COALESCE(CAST({r[2]} AS VARCHAR), 'None') "
                         f"AS label, CAST(COUNT(*) AS BIGINT) AS value FROM {r[0]} GROUP BY {r[2]}")
    return "\nUNION ALL\n".join(parts)
