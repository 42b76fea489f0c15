"""Mechanical checks as lazy DataFrame plans.

Each function takes DataFrames and returns a DataFrame of metrics with a
fixed schema; nothing is collected.  Shapes chosen for scale:

* null counts and the row count of one table are one ``agg`` (one scan);
* duplicate keys and value distributions come from one ``groupBy`` whose
  partial aggregation collapses hot keys before the shuffle, and the same
  grouped frame feeds the metric and the sample (the exchange is reused);
* the foreign-key rate groups the keys of both sides together in one
  aggregation (no join), so a key holding a third of the rows is one row
  per task and a non-unique parent is accounted for by multiplying counts
  instead of materialising the fan-out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preflight.config import SAMPLE_LIMIT
from preflight.functions.columns import outside
from preflight.functions.text import rounded_pct


def qcol(name: str) -> Column:
    """Column by exact name (dots and spaces allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


# ── A1 / A3: one pass per table ────────────────────────────────────────────

def row_count(df: DataFrame) -> DataFrame:
    """``row_count BIGINT`` — one row."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def table_profile(df: DataFrame, null_columns: list[str]) -> DataFrame:
    """Row count and the NULL count of every listed column in one scan.

    Columns: ``row_count`` and ``null_count_<i>`` (NULL on an empty table,
    as a SQL ``SUM`` over no rows)."""
    aggs = [F.count(F.lit(1)).alias("row_count")]
    for i, c in enumerate(null_columns):
        aggs.append(F.sum(F.when(qcol(c).isNull(), F.lit(1)).otherwise(F.lit(0)))
                    .cast("long").alias(f"null_count_{i}"))
    return df.agg(*aggs)


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, total_rows, null_count, null_pct`` of every listed column,
    from one scan."""
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"null_count_{i}").alias("null_count"))
                              for i, c in enumerate(columns)]))
    return (table_profile(df, columns).select(F.col("row_count").alias("total_rows"), each)
            .select("column_name", "total_rows", "null_count")
            .withColumn("null_pct", rounded_pct("null_count", "total_rows", 4)))


def null_rate(df: DataFrame, column: str) -> DataFrame:
    return null_rates(df, [column])


def null_sample(df: DataFrame, column: str, columns: list[str] | None = None,
                limit: int = SAMPLE_LIMIT) -> DataFrame:
    """Rows where ``column`` is NULL, showing ``columns`` (all when empty),
    top ``limit`` by those columns so the sample is deterministic."""
    cols = list(columns) if columns else list(df.columns)
    return (df.filter(qcol(column).isNull())
              .select(*[qcol(c) for c in cols])
              .orderBy(*[qcol(c).asc_nulls_first() for c in cols])
              .limit(limit))


def _tagged_json(checks: dict) -> Column:
    """The sample row of the check in ``tag``: its columns as JSON."""
    out = None
    for o, (_, cols) in checks.items():
        row = F.to_json(F.struct(*[qcol(c) for c in cols]))
        out = F.when(F.col("tag") == o, row) if out is None else out.when(F.col("tag") == o, row)
    return out


def null_samples(df: DataFrame, checks: dict[int, tuple[str, list[str]]], limit: int = SAMPLE_LIMIT) -> DataFrame:
    """``ordinal, row_no, row`` — the NULL samples (``null_sample``) of many
    checks, ``{ordinal: (column, sample columns)}``, from one scan.

    A row is tagged with the checks whose column is NULL; of each tag the
    first rows by that check's sample columns stay.  The limit on the row
    number is applied in each task before the shuffle (WindowGroupLimit)."""
    columns = list(dict.fromkeys(c for _, cols in checks.values() for c in cols))
    tags = F.array_compact(F.array(*[F.when(qcol(c).isNull(), F.lit(o)) for o, (c, _) in checks.items()]))
    some = None
    for c in dict.fromkeys(c for c, _ in checks.values()):
        some = qcol(c).isNull() if some is None else some | qcol(c).isNull()
    rows = df.filter(some).select(F.explode(tags).alias("tag"), F.struct(*[qcol(c) for c in columns]).alias("__r")).select("tag", "__r.*")
    return _first_rows(rows, [F.when(F.col("tag") == o, qcol(c)).asc_nulls_first()
                              for o, (_, cols) in checks.items() for c in cols], checks, limit)


def _first_rows(rows, order, checks, limit) -> DataFrame:
    w = Window.partitionBy("tag").orderBy(*order)
    return (rows.withColumn("__no", F.row_number().over(w)).filter(F.col("__no") <= limit)
            .select(F.col("tag").alias("ordinal"), (F.col("__no") - 1).alias("row_no"), _tagged_json(checks).alias("row")))


def pk_samples(df: DataFrame, checks: dict[int, tuple[str, list[str]]], limit: int = SAMPLE_LIMIT) -> DataFrame:
    """``ordinal, row_no, row`` — the most repeated keys (``pk_sample``) of
    many checks, ``{ordinal: (column, …)}``, from one scan and one shuffle."""
    from preflight.operators.fused import _gid, grouped_counts
    frame, columns = grouped_counts(df, [(c,) for c, _ in checks.values()], [], total=False)
    tags = F.array(*[F.when(F.col("gid") == _gid(columns, (c,)), F.lit(o)) for o, (c, _) in checks.items()])
    rows = frame.filter(F.col("n") > 1).select(F.explode(F.array_compact(tags)).alias("tag"),
                                               *[qcol(c) for c in columns], F.col("n").alias("occurrences"))
    return _first_rows(rows, [F.col("occurrences").desc()] + [F.when(F.col("tag") == o, qcol(c)).asc_nulls_first()
                                                             for o, (c, _) in checks.items()],
                       {o: (c, [c, "occurrences"]) for o, (c, _) in checks.items()}, limit)


# ── A2: key duplicates ─────────────────────────────────────────────────────

def key_groups(df: DataFrame, column: str) -> DataFrame:
    """``<column>, occurrences`` — one row per key value (NULL is a group)."""
    return df.groupBy(qcol(column)).agg(F.count(F.lit(1)).alias("occurrences"))


#: Values that one bitmap covers, and how many times as many as rows the
#: range of a column's values may be for bitmaps to be smaller than keys.
BITMAP_VALUES, DENSE = 32_768, 64


def distinct_by_bitmap(df: DataFrame, column: str) -> DataFrame:
    """``distinct_values`` of a whole-number column, exactly.

    A value is a bit in the bitmap of its range of ``BITMAP_VALUES``; a task
    sends one bitmap (4 kB) per range it meets, not its keys, and a key that a
    third of the rows hold is one bit."""
    v = qcol(column).cast("long")
    bits = (df.filter(qcol(column).isNotNull()).select(F.bitmap_bucket_number(v).alias("bucket"),
                                                       F.bitmap_bit_position(v).alias("at"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")))
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("distinct_values"))


def dense_keys(df: DataFrame, column: str):
    """``rows, low, high`` of a whole-number column whose values are dense
    enough for bitmaps, else None.  One pass over the column, one row."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        return None
    c = qcol(column)
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.min(c).alias("low"), F.max(c).alias("high")).first()
    if r["low"] is None or r["high"] - r["low"] > DENSE * r["rows"]:
        return None
    return r


def pk_duplicates(df: DataFrame, column: str,
                  groups: DataFrame | None = None) -> DataFrame:
    """``pk_column, total_rows, duplicate_count`` with
    duplicate_count = COUNT(*) − COUNT(DISTINCT column): every NULL key
    counts as a duplicate since DISTINCT skips NULLs.

    Without ``groups``, whole-number keys that are dense (``dense_keys``) are
    counted by bitmaps; all others are grouped."""
    dense = dense_keys(df, column) if groups is None else None
    if dense is not None:
        rows = F.lit(dense["rows"]).cast("long")
        return distinct_by_bitmap(df, column).select(
            F.lit(column).alias("pk_column"), rows.alias("total_rows"),
            (rows - F.col("distinct_values")).alias("duplicate_count"))
    g = groups if groups is not None else key_groups(df, column)
    total = F.coalesce(F.sum("occurrences"), F.lit(0)).cast("long")
    return g.agg(
        F.lit(column).alias("pk_column"),
        total.alias("total_rows"),
        (total - F.count(qcol(column))).cast("long").alias("duplicate_count"),
    )


def pk_sample(df: DataFrame, column: str, groups: DataFrame | None = None,
              limit: int = SAMPLE_LIMIT) -> DataFrame:
    """Most repeated keys: ``<column>, occurrences``, count desc, key asc."""
    g = groups if groups is not None else key_groups(df, column)
    return (g.filter(F.col("occurrences") > 1)
             .orderBy(F.col("occurrences").desc(), qcol(column).asc_nulls_first())
             .limit(limit))


# ── A4 / A5: domain of a column ────────────────────────────────────────────

def value_groups(df: DataFrame, column: str) -> DataFrame:
    """``value, row_count`` — one row per distinct value, NULL included."""
    return (df.groupBy(qcol(column).alias("value"))
              .agg(F.count(F.lit(1)).alias("row_count")))


def value_distribution(df: DataFrame, column: str,
                       groups: DataFrame | None = None) -> DataFrame:
    """``value, row_count, pct`` with pct = ROUND(100 * n / total, 2).

    The total is a scalar subquery over the grouped frame (its exchange is
    reused), not an unpartitioned window: no single task sees all groups.
    Most frequent first, then by value (O2)."""
    g = groups if groups is not None else value_groups(df, column)
    total = g.agg(F.sum("row_count")).scalar()
    return (g.withColumn("total_rows", total)
             .select("value", "row_count", rounded_pct("row_count", "total_rows", 2).alias("pct"))
             .orderBy(F.col("row_count").desc(), F.col("value").asc_nulls_first()))


def unexpected_values(df: DataFrame, column: str, accepted,
                      groups: DataFrame | None = None, dtype=None) -> DataFrame:
    """``unexpected_value, row_count`` — non-NULL values outside
    ``accepted``; accepted values are converted to the column type with
    ``try_cast`` (non-convertible ones match nothing).  Without ``groups``
    the filter runs on the rows before grouping, so only unexpected rows
    reach the shuffle."""
    dtype = dtype if dtype is not None else df.schema[column].dataType
    if groups is None:
        return (df.filter(outside(qcol(column), accepted, dtype))
                  .groupBy(qcol(column).alias("unexpected_value"))
                  .agg(F.count(F.lit(1)).alias("row_count")))
    v = F.col("value")
    return groups.filter(outside(v, accepted, dtype)).select(v.alias("unexpected_value"), "row_count")


# ── A6 / J1 / J2: referential integrity ───────────────────────────────────

def comparison_types(child: DataFrame, parent: DataFrame, keys: list[str],
                     parent_keys: list[str]) -> list:
    """Per key, the type in which Spark's ``=`` compares the two sides; None
    where they are of one type already.  Text is compared as the other
    side's type (whole numbers as BIGINT); of other pairs both sides are
    widened.  Neither side is ever narrowed."""
    out = []
    for k, pk in zip(keys, parent_keys):
        a, b = child.select(qcol(k)).schema[0].dataType, parent.select(qcol(pk)).schema[0].dataType
        if a == b:
            out.append(None)
        elif isinstance(a, T.StringType) or isinstance(b, T.StringType):
            other = b if isinstance(a, T.StringType) else a
            out.append(T.LongType() if isinstance(other, T.IntegralType) else other)
        else:
            both = child.sparkSession.range(0).select(
                F.coalesce(F.lit(None).cast(a), F.lit(None).cast(b)).alias("x"))
            out.append(both.schema[0].dataType)
    return out


def side_counts(child: DataFrame, parent: DataFrame, keys: list[str],
                parent_keys: list[str] | None = None, extra: dict | None = None,
                grouped: DataFrame | None = None, parent_grouped: DataFrame | None = None) -> DataFrame:
    """Per child key: ``<keys>, n`` (child rows) and ``m`` (parent rows with
    that key; NULL when there are none or a key part is NULL — an
    equi-join never matches those), plus ``extra`` sums over parent rows.

    Keys of one type on both sides: no join.  Both sides' keys are unioned
    with a side tag and grouped once.  Partial aggregation runs on each side
    before the single shuffle, so a key holding a third of either table is
    one row per task.

    Keys of different types are compared as Spark's ``=`` compares them
    (``comparison_types``): each side is grouped by its own key first, then
    the grouped keys are joined in the comparison type; a value that does not
    convert matches nothing.  Child keys keep their own type.  So it is with
    ``grouped`` and ``parent_grouped``, a side's ``<keys>, n`` if they are
    there already."""
    pkeys = list(parent_keys or keys)
    extra = extra or {}
    types = comparison_types(child, parent, keys, pkeys)
    if grouped is not None or parent_grouped is not None or any(types):
        return _joined_counts(child, parent, keys, pkeys, extra, types, grouped, parent_grouped)
    c = child.select(*[qcol(k) for k in keys], F.lit(1).alias("__c"), F.lit(0).alias("__p"),
                     *[F.lit(0).cast("long").alias(x) for x in extra])
    p = parent.select(*[qcol(pk).alias(k) for k, pk in zip(keys, pkeys)],
                      F.lit(0).alias("__c"), F.lit(1).alias("__p"),
                      *[e.cast("long").alias(x) for x, e in extra.items()])
    g = (c.union(p).groupBy(*[qcol(k) for k in keys])
         .agg(F.sum("__c").cast("long").alias("n"), F.sum("__p").cast("long").alias("m"),
              *[F.sum(x).cast("long").alias(x) for x in extra]))
    whole = None
    for k in keys:
        whole = qcol(k).isNotNull() if whole is None else whole & qcol(k).isNotNull()
    matched = whole & (F.col("m") > 0)
    return g.filter(F.col("n") > 0).select(
        *[qcol(k) for k in keys], "n", F.when(matched, F.col("m")).alias("m"),
        *[F.when(matched, F.col(x)).alias(x) for x in extra])


def _joined_counts(child, parent, keys, pkeys, extra, types, grouped, parent_grouped=None) -> DataFrame:
    def compared(column, own, to):
        return qcol(column) if to is None or own == to else qcol(column).try_cast(to)

    names = [f"__k{i}" for i in range(len(keys))]
    ctypes = [child.select(qcol(k)).schema[0].dataType for k in keys]
    ptypes = [parent.select(qcol(k)).schema[0].dataType for k in pkeys]
    if grouped is None:
        grouped = child.groupBy(*[qcol(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    c = (grouped
         .withColumns({x: compared(k, own, to) for x, k, own, to in zip(names, keys, ctypes, types)}))
    rows = F.lit(1).cast("long") if parent_grouped is None else F.col("n")
    p = ((parent if parent_grouped is None else parent_grouped)
         .select(*[compared(k, own, to).alias(x) for x, k, own, to in zip(names, pkeys, ptypes, types)],
                 rows.alias("m"), *[e.cast("long").alias(x) for x, e in extra.items()])
         .groupBy(*names).agg(F.sum("m").alias("m"), *[F.sum(x).cast("long").alias(x) for x in extra]))
    return c.join(p, names, "left").select(*[qcol(k) for k in keys], "n", "m", *extra)


def fk_groups(child: DataFrame, parent: DataFrame, keys: list[str], parent_keys: list[str] | None = None,
              grouped: DataFrame | None = None, parent_grouped: DataFrame | None = None) -> DataFrame:
    """Child keys with their row count ``n`` and the parent row count ``m``
    of the same key (NULL when unmatched).  ``parent_keys`` default to the
    child names."""
    return side_counts(child, parent, keys, parent_keys, None, grouped, parent_grouped)


def _match_aggs() -> list[Column]:
    n, m = F.col("n"), F.col("m")
    return [F.coalesce(F.sum(n * F.coalesce(m, F.lit(1))), F.lit(0)).cast("long").alias("child_rows"),
            F.sum(F.when(m.isNotNull(), n * m).otherwise(F.lit(0))).cast("long").alias("matched_rows")]


def fk_match_rates(fks: list[tuple]) -> DataFrame:
    """``fk, parent_model, join_keys, child_rows, matched_rows, match_pct`` of
    many foreign keys from the groups of both sides.

    ``fks``: ``(fk, parent name, keys, child groups, parent keys, parent
    groups)``, groups being ``<keys>, n``.  The key counts of all foreign keys
    whose keys are of the same types are one table with the foreign key's
    number in front, grouped once; keys of different types on the two sides
    are compared as ``side_counts`` compares them."""
    spark = fks[0][3].sparkSession
    alike, parts = {}, []
    for fk, _, keys, child, pkeys, parent in fks:
        types = [child.schema[k].dataType for k in keys]
        if types == [parent.schema[k].dataType for k in pkeys]:
            alike.setdefault(tuple(t.simpleString() for t in types), []).append((fk, keys, child, pkeys, parent))
        else:
            both = _joined_counts(child, parent, list(keys), list(pkeys), {},
                                  comparison_types(child, parent, list(keys), list(pkeys)), child, parent)
            parts.append(both.agg(*_match_aggs()).select(F.lit(fk).alias("fk"), "child_rows", "matched_rows"))
    for kinds, members in alike.items():
        names = [f"k{i}" for i in range(len(kinds))]
        rows = None
        for fk, keys, child, pkeys, parent in members:
            for cols, side, n, m in ((keys, child, F.col("n"), F.lit(0).cast("long")), (pkeys, parent, F.lit(0).cast("long"), F.col("n"))):
                part = side.select(F.lit(fk).alias("fk"), *[qcol(c).alias(k) for c, k in zip(cols, names)],
                                   n.alias("n"), m.alias("m"))
                rows = part if rows is None else rows.union(part)
        whole = None
        for k in names:
            whole = F.col(k).isNotNull() if whole is None else whole & F.col(k).isNotNull()
        both = rows.groupBy("fk", *names).agg(F.sum("n").alias("n"), F.sum("m").alias("m")).filter("n > 0")
        parts.append(both.select("fk", "n", F.when(whole & (F.col("m") > 0), F.col("m")).alias("m"))
                     .groupBy("fk").agg(*_match_aggs()))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    meta = spark.createDataFrame([(fk, parent, ", ".join(keys)) for fk, parent, keys, *_ in fks],
                                 "fk int, parent_model string, join_keys string")
    # one row per foreign key on either side; an empty child has none
    return (meta.join(F.broadcast(found), "fk", "left")
            .withColumn("child_rows", F.coalesce("child_rows", F.lit(0).cast("long")))
            .withColumn("match_pct", rounded_pct("matched_rows", "child_rows", 2)))


def fk_match_rate(child: DataFrame, parent: DataFrame, keys: list[str],
                  parent_name: str, groups: DataFrame | None = None,
                  parent_keys: list[str] | None = None) -> DataFrame:
    """``parent_model, join_keys, child_rows, matched_rows, match_pct``.

    Equal to ``child LEFT JOIN parent`` counted row by row:
    child_rows = Σ n·coalesce(m, 1), matched_rows = Σ n·m.  On an empty
    child: child_rows 0, matched_rows and match_pct NULL."""
    j = groups if groups is not None else fk_groups(child, parent, keys, parent_keys)
    return j.agg(
        F.lit(parent_name).alias("parent_model"),
        F.lit(", ".join(keys)).alias("join_keys"),
        *_match_aggs(),
    ).withColumn("match_pct", rounded_pct("matched_rows", "child_rows", 2))


def fk_sample(child: DataFrame, parent: DataFrame, keys: list[str],
              groups: DataFrame | None = None,
              limit: int = SAMPLE_LIMIT,
              parent_keys: list[str] | None = None) -> DataFrame:
    """Unmatched child keys: ``<keys>, unmatched_rows``, count desc, keys
    asc (NULL keys form one group)."""
    j = groups if groups is not None else fk_groups(child, parent, keys, parent_keys)
    return (j.filter(F.col("m").isNull())
             .select(*[qcol(k) for k in keys], F.col("n").alias("unmatched_rows"))
             .orderBy(F.col("unmatched_rows").desc(),
                      *[qcol(k).asc_nulls_first() for k in keys])
             .limit(limit))
