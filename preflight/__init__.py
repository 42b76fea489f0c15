"""preflight — pre-merge table review on Spark.

Declared rules (unique, not_null, accepted_values) and table lineage become
lazy DataFrame checks; results are graded PASS / WARN / FAIL, failing rows
are sampled and a severity-sorted report is written.  Everything is built
from the public DataFrame / SQL API; nothing runs row-at-a-time in Python.
"""

from preflight.config import BLAST_MAX_DEPTH, SAMPLE_LIMIT, ReviewOptions, Thresholds
from preflight.session import ensure_checkpoint_dir, get_spark
from preflight.sources.catalog import Catalog, declare_catalog, load_manifest
from preflight.sources.tables import TableResolver
from preflight.plans.checks import plan_checks
from preflight.plans.review import Review, review
from preflight.operators.lineage import blast_radius
from preflight.operators.edge_cases import EdgeCase, run_edge_cases
from preflight.operators.verdicts import merge_verdicts

__all__ = [
    "Thresholds", "ReviewOptions", "SAMPLE_LIMIT", "BLAST_MAX_DEPTH",
    "get_spark", "ensure_checkpoint_dir",
    "Catalog", "load_manifest", "declare_catalog", "TableResolver",
    "plan_checks", "review", "Review", "blast_radius",
    "EdgeCase", "run_edge_cases", "merge_verdicts",
]
