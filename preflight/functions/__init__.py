"""Column-expression helpers (all JVM-side built-ins, no UDFs)."""

from preflight.functions.text import (
    int_text, pct_text, rounded_pct, value_text, number_text, file_stem,
    ref_names,
)
from preflight.functions.columns import (
    sample_columns, status_rank, importance_rank, verdict_rank, outside, resolve_column,
)

__all__ = [
    "int_text", "pct_text", "rounded_pct", "value_text", "number_text",
    "file_stem", "ref_names", "sample_columns", "status_rank",
    "importance_rank", "verdict_rank", "outside, resolve_column",
]
