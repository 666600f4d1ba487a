"""Connected components by alternating stars, on pairs that may number as many as the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, least): the least of u and its v's. Minima are taken before the shuffle; hot u's are left to the skew join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("least", F.least("u", "m"))


def _mark(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node in ``links`` (u, v); label is the least node of its component.

    Large star: every larger neighbour of u is tied to the least of u's neighbourhood. Small star: so is every smaller
    one, and u. Repeated until the pairs stay as they are, which takes about the logarithm of the longest path. Each
    round is checkpointed; only a count and a hash of the pairs come to the driver. No links give no rows.
    """
    pairs = checkpoint(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(pairs)
    while before[0]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        tied = _with_least(large)
        small = tied.select(F.col("u"), F.col("least").alias("v")).union(tied.select(F.col("v").alias("u"), F.col("least").alias("v")))
        pairs = checkpoint(small.where("u <> v").distinct())
        now = _mark(pairs)
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
