"""Fixpoints over edge tables. A round joins the frontier with the edges and drops what has been seen; each round is a
table in the shared folder, so lineage stays short and a lost executor costs one round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import shared_table


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """GLAMBDA's meaning for relations: rows are derived until none is new; a repeated goal adds nothing, so cycles end.

    ``step`` derives rows of the same columns from the rows of the last round. There is no bound on rounds: a result is whole.
    """
    seen = frontier = shared_table(start.distinct())
    rounds = 0
    while True:
        new = step(frontier).select(*start.columns).distinct()
        on = [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in start.columns]
        fresh = shared_table(new.alias("n").join(seen.alias("s"), on, "left_anti"))
        if fresh.isEmpty():
            return seen
        rounds += 1
        frontier = fresh
        seen = seen.unionByName(fresh)
        if rounds % 8 == 0:
            seen = shared_table(seen)  # few large files instead of a long union


def get_star(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """GET*: (root, node) for every node reachable from a root, the root included; roots has root, edges has src and dst."""
    start = roots.select("root", F.col("root").alias("node"))
    step = lambda f: f.join(edges, f["node"] == edges["src"]).select("root", F.col("dst").alias("node"))
    return fixpoint(start, step)


def value_path(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """VALUE-PATH?: pairs (a, b) with a boolean ``path``: whether b is reachable from a."""
    reach = get_star(pairs.select(F.col("a").alias("root")).distinct(), edges)
    hit = pairs.join(reach, (F.col("a") == F.col("root")) & (F.col("b") == F.col("node")), "left")
    return hit.select("a", "b", F.col("node").isNotNull().alias("path"))


def inherit_values(roots: DataFrame, through: DataFrame, values: DataFrame) -> DataFrame:
    """INHERIT-VALUES, FD:INHERITED-GET: (root, value) over the root and all that is reachable; values has oid, value."""
    reach = get_star(roots, through)
    return reach.join(values, reach["node"] == values["oid"]).select("root", "value").distinct()


def inherits_value(roots: DataFrame, through: DataFrame, values: DataFrame, value) -> DataFrame:
    """INHERITS-VALUE?, FD:INHERITED-TEST: the roots that reach a frame with the value."""
    return inherit_values(roots, through, values.filter(F.col("value") == value)).select("root").distinct()
