"""Run the table checks on every micro-batch of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflight.config import Thresholds
from preflight.operators.fused import graded, table_checks
from preflight.plans.checks import CheckSpec


def batch_checks(batch: DataFrame, unique: list[str], not_null: list[str],
                 thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Graded ``check, target, status, detail`` of one micro-batch, from the
    same single scan and shuffle as a table's checks."""
    todo = [("row_count", None), *(("null_rate", c) for c in not_null), *(("pk_duplicates", c) for c in unique)]
    specs = [CheckSpec(i, "batch", "batch", check, "", "batch", column) for i, (check, column) in enumerate(todo)]
    rows = graded(table_checks(batch, specs, batch.schema), thresholds)
    name = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("ordinal") + 1)
    return rows.select(name([c for c, _ in todo]).alias("check"), name([c or "" for _, c in todo]).alias("target"),
                       "status", "detail")


def review_batches(stream: DataFrame, sink_path: str, checkpoint: str,
                   unique: list[str] = (), not_null: list[str] = (),
                   trigger_once: bool = False):
    """Start a query appending each micro-batch's graded checks (tagged
    with ``batch_id``) to a parquet table.  ``checkpoint`` must be a
    shared folder so the query restarts where it stopped."""
    def run(batch: DataFrame, batch_id: int):
        (batch_checks(batch, list(unique), list(not_null))
         .withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("append").parquet(sink_path))

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
