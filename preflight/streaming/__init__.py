"""Streaming.

The reviewed tool has no streaming surface: it checks tables at rest
before a merge.  Nothing here re-implements one; ``review_batches`` only
lets the same fused table checks run on each micro-batch of a
Structured Streaming source through ``foreachBatch`` (batch semantics per
micro-batch, no cross-batch state).
"""

from preflight.streaming.batches import review_batches

__all__ = ["review_batches"]
