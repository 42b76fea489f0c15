"""One scan and one shuffle for all checks of a table.

Every non-join check of a review needs, per table, either global counts
(rows, NULLs per column) or counts grouped by one column (duplicate keys,
value domains).  ``table_checks`` computes all of them from a single
``GROUPING SETS`` aggregation: Spark expands each row once per set,
aggregates partially before the shuffle (a key holding a third of the rows
leaves each task as one row per set) and shuffles once.  A second,
global aggregation over those groups — tiny, one row out — turns them into
the metrics of every check, which are then laid out one row per check and
graded with expressions shared by all checks of a kind.

``TableGroups`` does the same for a whole review: what other tables' foreign
keys, value lists and samples need of the groups is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preflight.config import MAX_GROUPING_SETS, Thresholds
from preflight.functions.text import int_text, pct_text, rounded_pct
from preflight.functions.columns import outside
from preflight.operators.checks import fk_match_rates, qcol
from preflight.operators.grade import FAIL, NO_ROWS, PASS, WARN

GROUPED = ("pk_duplicates", "value_distribution", "unexpected_values")
FUSED = GROUPED + ("null_rate", "row_count")

METRICS = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("total_rows", T.LongType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("duplicate_count", T.LongType()),
    T.StructField("distinct_values", T.LongType()),
    T.StructField("unexpected_count", T.LongType()),
    T.StructField("unexpected_rows", T.LongType()),
])


def grouped_counts(df: DataFrame, sets, null_columns, total: bool = True) -> tuple[DataFrame, list[str]]:
    """``<columns>, n, null_count_<i>…, gid`` — one GROUPING SETS aggregate
    over ``sets`` plus, with ``total``, the empty set (whole-table counts)."""
    sets = list(dict.fromkeys(tuple(s) for s in sets if s))
    columns = list(dict.fromkeys(c for s in sets for c in s))
    nulls = [F.sum(F.when(qcol(c).isNull(), F.lit(1)).otherwise(F.lit(0))).cast("long")
             .alias(f"null_count_{i}") for i, c in enumerate(null_columns)]
    n = F.count(F.lit(1)).alias("n")
    if sets:
        frame = (df.groupingSets([[qcol(c) for c in s] for s in sets] + [[]] * total,
                                 *[qcol(c) for c in columns])
                 .agg(n, *nulls, F.grouping_id().cast("long").alias("gid")))
    else:
        frame = df.agg(n, *nulls, F.lit(0).cast("long").alias("gid"))
    return frame, columns


def _gid(columns: list[str], cols) -> int:
    k = len(columns)
    return sum(1 << (k - 1 - i) for i, c in enumerate(columns) if c not in cols)


def ident(name: str) -> str:
    """Quoted identifier for a Spark SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    """Spark SQL string literal (backslash escapes)."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _accepted_sql(values, dtype: T.DataType) -> str:
    """Accepted values as an array literal of the column type; values that
    do not convert (``try_cast`` gives NULL) are dropped, so they match
    nothing and raise nothing."""
    texts = ["True" if v is True else "False" if v is False else str(v) for v in values]
    t = dtype.simpleString()
    if not texts:
        return f"CAST(array() AS array<{t}>)"
    if isinstance(dtype, T.StringType):
        return "array(" + ", ".join(text_literal(x) for x in texts) + ")"
    return "array_compact(array(" + ", ".join(
        f"try_cast({text_literal(x)} AS {t})" for x in texts) + "))"


def check_sets(specs) -> tuple[list[tuple], list[str]]:
    """Grouping sets and NULL-counted columns that ``specs`` need."""
    nulls = list(dict.fromkeys(s.column for s in specs if s.check == "null_rate"))
    sets = [(s.column,) for s in specs if s.check in GROUPED]
    return list(dict.fromkeys(sets)), nulls


def metric_sql(specs, schema, columns: list[str], null_cols: list[str]) -> dict[int, dict[str, str]]:
    """Per check (by ordinal) its metrics as SQL aggregates over the groups."""
    everything = f"gid = {_gid(columns, ())}"
    out = {}
    for s in specs:
        vals = {"total_rows": f"max(CASE WHEN {everything} THEN n END)"}
        if s.check in GROUPED:
            c = ident(s.column)
            mine = f"gid = {_gid(columns, (s.column,))}"
        if s.check == "null_rate":
            vals["null_count"] = f"max(CASE WHEN {everything} THEN null_count_{null_cols.index(s.column)} END)"
        elif s.check == "pk_duplicates":
            vals["total_rows"] = f"coalesce(sum(CASE WHEN {mine} THEN n END), 0)"
            vals["duplicate_count"] = f"{vals['total_rows']} - count(CASE WHEN {mine} THEN {c} END)"
        elif s.check == "value_distribution":
            vals["distinct_values"] = f"count(CASE WHEN {mine} THEN 1 END)"
        elif s.check == "unexpected_values":
            bad = (f"{mine} AND {c} IS NOT NULL AND NOT coalesce(array_contains("
                   f"{_accepted_sql(s.accepted or (), schema[s.column].dataType)}, {c}), false)")
            vals["unexpected_count"] = f"count(CASE WHEN {bad} THEN 1 END)"
            vals["unexpected_rows"] = f"coalesce(sum(CASE WHEN {bad} THEN n END), 0)"
        out[s.ordinal] = vals
    return out


def table_checks(df: DataFrame, specs, schema) -> DataFrame:
    """``METRICS`` rows, one per check in ``specs`` (kinds in ``FUSED``),
    from one scan and one shuffle of ``df``.

    The per-check metrics are one global aggregate over the grouping-sets
    result and the per-check rows one ``stack``; both are written as Spark
    SQL expressions so a table's plan is parsed once (building the same
    from thousands of Column calls costs seconds of driver round-trips)."""
    sets, null_cols = check_sets(specs)
    frame, columns = grouped_counts(df, sets, null_cols)
    aggs, rows = [], []
    metrics = metric_sql(specs, schema, columns, null_cols)
    for s in specs:
        vals = metrics[s.ordinal]
        fields = [f"CAST({s.ordinal} AS INT)", text_literal(s.check), text_literal(s.column or "")]
        for f in METRICS.fields[3:]:
            if f.name in vals:
                aggs.append(f"{vals[f.name]} AS {f.name}_{s.ordinal}")
            value = f"{f.name}_{s.ordinal}" if f.name in vals else "NULL"
            fields.append(f"CAST({value} AS {f.dataType.simpleString()})")
        rows.append(", ".join(fields))
    names = ", ".join(f.name for f in METRICS.fields)
    return frame.selectExpr(*aggs).selectExpr(f"stack({len(rows)}, {', '.join(rows)}) AS ({names})")


class TableGroups:
    """A table's groups, computed by one scan and one shuffle for all its readers.

    The metrics of the table's checks are observed while the groups pass;
    the groups of the sets in ``keep`` (keys of foreign keys on either side,
    columns whose values are listed) are written under the checkpoint folder,
    by set, and read from there by everything that needs them.  Without such
    sets nothing is written.  More than ``limit`` sets are more scans."""

    def __init__(self, df: DataFrame, schema, specs, keep, limit: int):
        self.df, self.schema, self.specs = df, schema, list(specs)
        self.keep = list(dict.fromkeys(tuple(k) for k in keep))
        self.limit = limit
        self.metrics: list[tuple] = []
        self._written: dict[tuple, tuple] = {}

    def chunks(self) -> list[list[tuple]]:
        sets = list(dict.fromkeys([*check_sets(self.specs)[0], *self.keep]))
        return [sets[i:i + self.limit] for i in range(0, len(sets), self.limit)] or [[]]

    def run(self) -> "TableGroups":
        nulls = check_sets(self.specs)[1]
        for i, sets in enumerate(self.chunks()):
            own = [s for s in self.specs if ((s.column,) in sets if s.check in GROUPED else i == 0)]
            self._run(sets, own, nulls if i == 0 else [])
        return self

    def _run(self, sets, specs, nulls) -> None:
        frame, columns = grouped_counts(self.df, sets, nulls)
        metrics = metric_sql(specs, self.schema, columns, nulls)
        exprs = [F.expr(sql).cast("long").alias(f"{name}_{o}") for o, vals in metrics.items() for name, sql in vals.items()]
        keep = [k for k in self.keep if k in sets]
        if keep:
            gids = {k: _gid(columns, k) for k in keep}
            got, path = write_groups(frame, columns, list(gids.values()), exprs)
            for k in keep:
                self._written[k] = (path, gids[k], [columns.index(c) for c in k])
        else:
            row = frame.agg(*exprs).first() if exprs else None
            got = row.asDict() if row else {}
        for s in specs:
            self.metrics.append((s.ordinal, s.check, s.column or "",
                                 *(got.get(f"{f.name}_{s.ordinal}") for f in METRICS.fields[3:])))

    def rows(self, keys) -> DataFrame:
        """``<keys>, n`` of one kept set, read from its files only."""
        path, gid, at = self._written[tuple(keys)]
        spark = self.df.sparkSession
        fields = [T.StructField(f"k{i}", self.schema[c].dataType) for i, c in zip(at, keys)]
        schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("gid", T.LongType())])
        return spark.read.schema(schema).parquet(path).filter(F.col("gid") == gid).select(
            *[F.col(f"k{i}").alias(c) for i, c in zip(at, keys)], "n")


class TableReads:
    """What ``TableGroups`` give of a table, found by group testing.

    If the table's action fails, its checks and kept sets are halved until
    each action succeeds or is left with one of them: one bad check of 64 costs
    about a dozen actions, not 64.  What fails alone is in none of ``parts``."""

    def __init__(self, df: DataFrame, schema, specs, keep, limit: int):
        self.parts: list[TableGroups] = []
        self.actions = 0
        items = [("own", s) for s in specs] + [("keep", k) for k in dict.fromkeys(tuple(k) for k in keep)]
        self._args = (df, schema, limit)
        if items:
            self._solve(items, False)

    def _run(self, items) -> bool:
        df, schema, limit = self._args
        self.actions += 1
        try:
            self.parts.append(TableGroups(df, schema, [x for kind, x in items if kind == "own"],
                                          [x for kind, x in items if kind == "keep"], limit).run())
            return True
        except Exception:  # noqa: BLE001 - looked into, or reported by the check on its own
            return False

    def _solve(self, items, bad: bool) -> None:
        """``bad``: these are known to fail together."""
        if not bad and self._run(items):
            return
        if len(items) == 1:
            if bad:
                self._run(items)
            return
        left, right = items[:len(items) // 2], items[len(items) // 2:]
        if self._run(left):
            self._solve(right, True)
        else:
            self._solve(left, True) if len(left) > 1 else None
            self._solve(right, False)

    @property
    def metrics(self) -> list[tuple]:
        return [m for p in self.parts for m in p.metrics]

    def has(self, keys) -> bool:
        return any(tuple(keys) in p.keep for p in self.parts)

    def release(self) -> None:
        """Delete the written groups; ``rows`` cannot be read after that."""
        from preflight.session import delete_scratch
        for p in self.parts:
            delete_scratch(p.df.sparkSession, {path for path, _, _ in p._written.values()})

    def rows(self, keys) -> DataFrame:
        return next(p for p in self.parts if tuple(keys) in p.keep).rows(keys)


def shared_fk_match_rates(frames: dict, fks, limit: int = MAX_GROUPING_SETS, threads: int = 8) -> DataFrame:
    """``fk, parent_model, join_keys, child_rows, matched_rows, match_pct`` of
    foreign keys ``(child, parent, keys, parent keys)`` between named frames.
    Each frame is read once, for all keys it has on either side; the groups
    are compared together (``checks.fk_match_rates``)."""
    from concurrent.futures import ThreadPoolExecutor

    keep: dict = {}
    for child, parent, keys, pkeys in fks:
        keep.setdefault(child, []).append(tuple(keys))
        keep.setdefault(parent, []).append(tuple(pkeys))
    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        groups = dict(pool.map(lambda name: (name, TableGroups(frames[name], frames[name].schema, [], keep[name], limit).run()), keep))
    return fk_match_rates([(i, parent, keys, groups[child].rows(keys), pkeys, groups[parent].rows(pkeys))
                           for i, (child, parent, keys, pkeys) in enumerate(fks)])


def write_groups(frame: DataFrame, columns: list[str], gids: list[int], exprs) -> tuple[dict, str]:
    """Write the groups of some sets, a folder each; what ``exprs`` observe of
    all groups, and the path."""
    import uuid

    from pyspark.sql import Observation

    from preflight.session import scratch_path

    path = scratch_path(frame.sparkSession, "groups")
    obs = Observation(f"groups-{uuid.uuid4().hex[:8]}")
    seen = frame.observe(obs, *exprs) if exprs else frame
    (seen.filter(F.col("gid").isin(gids))
     .select(*[qcol(c).alias(f"k{i}") for i, c in enumerate(columns)], "n", "gid")
     .write.partitionBy("gid").parquet(path))
    return (dict(obs.get) if exprs else {}), path


def listed_values(groups: DataFrame, column: str, accepted, dtype) -> DataFrame:
    """``column_name, value, row_count, unexpected`` from ``<column>, n`` groups."""
    off = F.lit(False) if accepted is None else outside(qcol(column), accepted, dtype)
    return groups.select(F.lit(column).alias("column_name"), qcol(column).cast("string").alias("value"),
                         F.col("n").alias("row_count"), off.alias("unexpected"))


def value_rows(df: DataFrame, columns: dict, schema) -> DataFrame:
    """``column_name, value, row_count, unexpected`` — every distinct value of
    every column in ``columns`` (name -> accepted values, None: any) with its
    rows and whether it is outside the accepted ones; one scan, one shuffle."""
    names = list(columns)
    frame, order = grouped_counts(df, [(c,) for c in names], [], total=False)
    gid = F.col("gid")
    name = value = bad = None
    for c in names:
        mine = gid == _gid(order, (c,))
        text = qcol(c).cast("string")
        off = F.lit(False) if columns[c] is None else outside(qcol(c), columns[c], schema[c].dataType)
        name = F.when(mine, F.lit(c)) if name is None else name.when(mine, F.lit(c))
        value = F.when(mine, text) if value is None else value.when(mine, text)
        bad = F.when(mine, off) if bad is None else bad.when(mine, off)
    return frame.select(name.alias("column_name"), value.alias("value"), F.col("n").alias("row_count"),
                        bad.alias("unexpected"))


_GRADE: dict = {}


def graded(metrics: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``ordinal, status, detail`` of ``METRICS`` rows; one expression per
    output column covers every kind (built once per threshold set)."""
    if t not in _GRADE:
        kind, total = F.col("kind"), F.col("total_rows")
        col = F.col("column_name")
        nulls, dup = F.col("null_count"), F.col("duplicate_count")
        pct = rounded_pct(nulls, total, 4)
        rate = pct / F.lit(100.0)
        k = F.col("unexpected_count")
        status = (F.when(kind == "row_count", F.when(F.coalesce(total, F.lit(0)) == 0, FAIL)
                         .otherwise(PASS))
                  .when(kind == "pk_duplicates", F.when(dup > 0, FAIL).otherwise(PASS))
                  .when(kind == "null_rate", F.when(pct.isNull(), FAIL)
                        .when(rate > F.lit(t.null_rate_fail), FAIL)
                        .when(rate > F.lit(t.null_rate_warn), WARN).otherwise(PASS))
                  .when(kind == "unexpected_values", F.when(k == 0, PASS).otherwise(WARN))
                  .otherwise(PASS))
        detail = (F.when(kind == "row_count",
                         F.concat(int_text(F.coalesce(total, F.lit(0))), F.lit(" rows")))
                  .when(kind == "pk_duplicates",
                        F.concat(int_text(dup), F.lit(" duplicate "), col,
                                 F.lit(" values out of "), int_text(total), F.lit(" rows")))
                  .when(kind == "null_rate", F.when(pct.isNull(), F.lit(NO_ROWS)).otherwise(
                        F.concat(int_text(nulls), F.lit(" nulls in "), col, F.lit(" ("),
                                 pct_text(pct, 4), F.lit("%) out of "), int_text(total),
                                 F.lit(" rows"))))
                  .when(kind == "unexpected_values", F.when(k == 0, F.lit("No unexpected values found"))
                        .otherwise(F.concat(int_text(k), F.lit(" unexpected value(s) in "),
                                            int_text("unexpected_rows"), F.lit(" rows"))))
                  .otherwise(F.concat(F.col("distinct_values").cast("string"),
                                      F.lit(" distinct values in "), col)))
        _GRADE[t] = (status.alias("status"), detail.alias("detail"))
    st, de = _GRADE[t]
    return metrics.select("ordinal", st, de)
