"""Joins that stay even when one key holds a large share of the rows, and the
key of a document's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], by: Column,
                salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Equi-join in which the rows of a key of ``big`` are dealt over
    ``salts`` partitions by the hash of ``by``; the rows of ``small`` (few
    to a key) are repeated once per salt."""
    b = big.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    s = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, [*keys, "__salt"], how).drop("__salt")


def row_hash() -> Column:
    """What tells documents apart: id and text."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def least_of_frequent(counts: DataFrame, limit: int) -> int:
    """The least power of two (or 0: all) such that at most ``limit`` rows of
    ``counts`` have ``n`` of that or more.  One row per power comes to the
    driver."""
    power = F.when(F.col("n") > 0, F.floor(F.log2("n") + F.lit(1e-9))).otherwise(F.lit(-1)).cast("int")
    got = {r["p"]: r["k"] for r in counts.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()}
    least, room = max(got, default=-1) + 1, limit
    for p in sorted(got, reverse=True):
        room -= got[p]
        if room < 0:
            return 1 << least
        least = p
    return 0
