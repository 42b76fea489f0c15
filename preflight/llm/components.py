"""Connected components of a link table.

Alternating large-star and small-star rounds: every node's links are moved
to the smallest neighbour, first those to larger nodes, then those to
smaller ones, until nothing moves; then each node points to the smallest
node of its component.  Every round (two aggregations and joins) is written
under the session's checkpoint folder; links of one node are dealt over
salts, so a centre of a third of all links is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflight.llm.joins import salted_join
from preflight.session import materialize


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """``pairs``: u, v.  Links of u to its larger (or smaller) neighbours
    move to u's smallest neighbour."""
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both if larger else both.filter(F.col("v") < F.col("u"))
    least = side.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("m", "u").alias("m"))
    move = both.filter(F.col("v") > F.col("u")) if larger else side
    moved = salted_join(move, least, ["u"], F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b (one comparable type, no nulls).  Returns ``node,
    component`` for every node of a link between different nodes, with the
    smallest node of the component."""
    edges = materialize(links.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(),
                        "links")
    mark = None
    while True:
        edges = materialize(_star(_star(edges, larger=True), larger=False), "star")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(
            F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    root = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(root)
