"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two grouped minima and two equi-joins; links stay distributed, and each round's links are a table in the
shared folder, so a lost executor costs one round at most. Hot nodes are met by map-side minima and by skewed joins that
are split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table


def _state(e: DataFrame) -> tuple:
    """Number of links and two sums of 64-bit hashes: different sets of links agree in all with a chance of about 2 ** -128."""
    wide = lambda h: F.sum(h.cast("decimal(20,0)"))
    return tuple(e.agg(F.count("*"), wide(F.xxhash64("u", "v")), wide(F.xxhash64(F.lit(1), "v", "u"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (a, b); component is the smallest node that it reaches."""
    e = shared_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = shared_table(small.filter("u <> v").distinct())
        before, state = state, _state(e)
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
