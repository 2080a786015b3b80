"""Clauses (slots, values) over long rows (oid, slot, value) as bit masks: one filter and one map-side grouped aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Clause = tuple[str | list[str], list]
WIDTH = 62


def _hit(clause: Clause) -> Column:
    slots, values = clause
    names = [slots] if isinstance(slots, str) else slots
    return F.col("slot").isin(*names) & F.col("value").isin(*map(str, values))


def masks(rows: DataFrame, clauses: list[Clause]) -> tuple[DataFrame, list[tuple[str, int]]]:
    """(oid, m0, m1, ...) and each mask's name and number of clauses: a bit is set if its clause holds, 62 bits a mask."""
    if not clauses:
        raise ValueError("no clause")
    groups = [clauses[i : i + WIDTH] for i in range(0, len(clauses), WIDTH)]
    bit = lambda i, c: F.when(_hit(c), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    words = [reduce(lambda a, b: a.bitwiseOR(b), (bit(i, c) for i, c in enumerate(g))) for g in groups]
    sizes = [(f"m{j}", len(g)) for j, g in enumerate(groups)]
    found = rows.filter(reduce(lambda a, b: a | b, map(_hit, clauses))).groupBy("oid")
    return found.agg(*(F.bit_or(w).alias(name) for w, (name, _) in zip(words, sizes))), sizes


def all_hold(rows: DataFrame, clauses: list[Clause]) -> DataFrame:
    """(oid): every clause holds."""
    found, sizes = masks(rows, clauses)
    return found.filter(reduce(lambda a, b: a & b, (F.col(m) == F.lit((1 << n) - 1) for m, n in sizes))).select("oid")


def count_held(rows: DataFrame, clauses: list[Clause]) -> DataFrame:
    """(oid, score): how many clauses hold; frames that none holds are left out."""
    found, sizes = masks(rows, clauses)
    return found.select("oid", reduce(lambda a, b: a + b, (F.bit_count(m) for m, _ in sizes)).cast("long").alias("score"))
