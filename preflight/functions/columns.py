"""Column choice and ranking helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed orders of the report.
STATUS_ORDER = {"FAIL": 0, "WARN": 1, "PASS": 2}
IMPORTANCE_ORDER = {"TIER0": 0, "HIGH": 1, "NORMAL": 2}
VERDICT_ORDER = {"action_required": 0, "investigate": 1}
UNRANKED = 9

# Name fragments that mark identifier-like columns for samples.
ID_HINTS = ("id", "name", "key")
SAMPLE_COLUMNS = 4


def sample_columns(columns: list[str], exclude: str | None = None,
                   limit: int = SAMPLE_COLUMNS) -> list[str]:
    """Columns shown in a null-row sample: the ``limit`` of lowest rank, in the
    table's order within a rank.  Rank 0 has a hint anywhere in its name,
    whatever the case; the tested column has none.  No column: show all."""
    def rank(name: str) -> int:
        return 0 if re.search("|".join(ID_HINTS), name, re.IGNORECASE) else 1

    return sorted((c for c in columns if c != exclude), key=rank)[:limit]


def _rank(c: Column, order: dict, other: int) -> Column:
    expr = None
    for name, rank in order.items():
        expr = (F.when(c == name, rank) if expr is None
                else expr.when(c == name, rank))
    return expr.otherwise(other)


def status_rank(c="status") -> Column:
    return _rank(F.col(c) if isinstance(c, str) else c, STATUS_ORDER, UNRANKED)


def importance_rank(c="importance") -> Column:
    return _rank(F.col(c) if isinstance(c, str) else c, IMPORTANCE_ORDER, UNRANKED)


def verdict_rank(c="verdict_status") -> Column:
    return _rank(F.col(c) if isinstance(c, str) else c, VERDICT_ORDER, 2)


def outside(c: Column, values, dtype: T.DataType) -> Column:
    """Non-NULL and none of the accepted values (text), compared in the
    column's type.

    A value that does not convert (``'zz'`` for an integer column) becomes
    NULL through ``try_cast`` and stands for one that does convert; if none
    does, every non-NULL value is outside.  All of this folds to ``NOT IN``
    over literals, which reaches the scan."""
    if not isinstance(dtype, T.AtomicType):
        raise ValueError(f"accepted values need a column of a simple type, not {dtype.simpleString()}")
    texts = ["True" if v is True else "False" if v is False else str(v) for v in values]
    if not texts:
        return c.isNotNull()
    if isinstance(dtype, T.StringType):
        return c.isNotNull() & ~c.isin(*texts)
    typed = [F.lit(x).try_cast(dtype) for x in texts]
    some = F.coalesce(*typed)
    return c.isNotNull() & (some.isNull() | ~c.isin(*[F.coalesce(x, some) for x in typed]))


def resolve_column(columns: list[str], name: str, case_sensitive: bool) -> str | None:
    """The column that a rule's ``name`` means, following the session's
    ``spark.sql.caseSensitive``; None when there is none, an error when
    two differ in case only and neither is spelled like it."""
    if name in columns or case_sensitive:
        return name if name in columns else None
    found = [c for c in columns if c.lower() == name.lower()]
    if len(found) > 1:
        raise ValueError(f"column {name} is ambiguous: {', '.join(found)}")
    return found[0] if found else None
