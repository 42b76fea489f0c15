"""Review options.  Plain Python values, turned into literals in plans."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that must equal the reviewed behaviour:
# rows in a failing-row sample, default lineage depth, default thresholds
# (null rate fail 5 %, warn 0.1 %; foreign-key match fail below 95 %,
# warn below 99 %).
SAMPLE_LIMIT = 5
BLAST_MAX_DEPTH = 10

# Grouped columns per fused table scan: GROUPING SETS copies each row once
# per set before partial aggregation, so wide rule sets are split into
# several scans of at most this many sets.
MAX_GROUPING_SETS = 16

CATEGORIES = ("grain", "distribution", "join", "rowcount")


@dataclass(frozen=True)
class Thresholds:
    null_rate_fail: float = 0.05
    null_rate_warn: float = 0.001
    fk_match_rate_fail: float = 0.95
    fk_match_rate_warn: float = 0.99


@dataclass(frozen=True)
class ReviewOptions:
    """Options of one review (the YAML file of a CLI tool, as plain values).

    ``join_keys``  {child model: {parent model: [columns]}} overrides inference.
    ``schema_map`` {old: new} substring rewrite applied to relation names
                   (first match wins, all occurrences replaced).
    """

    categories: tuple[str, ...] | None = None
    join_keys: dict = field(default_factory=dict)
    schema_map: dict = field(default_factory=dict)
    thresholds: Thresholds = Thresholds()
    dry_run: bool = False
    max_depth: int = BLAST_MAX_DEPTH
    sample_limit: int = SAMPLE_LIMIT
