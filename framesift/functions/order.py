"""The cross-type total order: numbers before other kinds, strings by length in bytes before content, vectors by length.

``order_key`` gives a struct whose field-wise order is that order; sort by it, or compare two of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank of kinds in the total order.
RANKS = {"number": 0, "oid": 1, "character": 2, "symbol": 3, "string": 4, "vector": 5, "other": 6}


def order_key(value: Column, kind: str) -> Column:
    """kind: number, string, symbol, oid or vector (of numbers)."""
    number = value.cast("double") if kind in ("number", "oid") else F.lit(None).cast("double")
    text = value.cast("string") if kind in ("string", "symbol") else F.lit(None).cast("string")
    length = F.octet_length(value) if kind == "string" else F.size(value) if kind == "vector" else F.lit(0)
    items = value.cast("array<double>") if kind == "vector" else F.lit(None).cast("array<double>")
    return F.struct(F.lit(RANKS[kind]).alias("rank"), number.alias("number"), length.alias("length"), text.alias("text"), items.alias("items"))


def any_greater(a: Column, a_kind: str, b: Column, b_kind: str) -> Column:
    """ANY>?."""
    return order_key(a, a_kind) > order_key(b, b_kind)


def any_less(a: Column, a_kind: str, b: Column, b_kind: str) -> Column:
    """ANY<?."""
    return order_key(a, a_kind) < order_key(b, b_kind)
