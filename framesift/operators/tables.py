"""Hashtables and hashsets: keyed and distinct DataFrames. A table has key and value, or several values per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def increment(events: DataFrame, key: list[str], amount: Column | None = None) -> DataFrame:
    """HASHTABLE-INCREMENT!: grouped count, or sum of an amount; combined map-side."""
    return events.groupBy(*key).agg((F.count("*") if amount is None else F.sum(amount)).alias("value"))


def increment_existing(table: DataFrame, events: DataFrame, key: list[str], amount: Column | None = None) -> DataFrame:
    """HASHTABLE-INCREMENT-EXISTING!: only keys that the table has; events are summed before the join."""
    more = increment(events, key, amount).withColumnRenamed("value", "_more")
    return table.join(more, key, "left").select(*key, (F.col("value") + F.coalesce("_more", F.lit(0))).alias("value"))


def add(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """HASHTABLE-ADD!: the value set of each key, as distinct rows."""
    return rows.select(*key, value).distinct()


def add_sets(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """HASHTABLE-ADD! with sets as values; for keys whose sets are bounded."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set(value)).alias(value))


def get(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """HASHTABLE-GET."""
    return table.join(keys.select(*key).distinct(), key, "left_semi")


def probe(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """HASHTABLE-PROBE, HASHSET-PROBE: keys with a boolean ``present``."""
    have = table.select(*key).distinct().withColumn("_p", F.lit(True))
    return keys.select(*key).distinct().join(have, key, "left").select(*key, F.coalesce("_p", F.lit(False)).alias("present"))


def set_(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """HASHTABLE-SET!."""
    return zap(table, rows, key).unionByName(rows.select(*table.columns))


def zap(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """HASHTABLE-ZAP!."""
    return table.join(keys.select(*key).distinct(), key, "left_anti")


def keys(table: DataFrame, key: list[str]) -> DataFrame:
    """HASHTABLE-KEYS."""
    return table.select(*key).distinct()


def values(table: DataFrame, value: str = "value") -> DataFrame:
    """HASHTABLE-VALUES."""
    return table.select(value).filter(F.col(value).isNotNull()).distinct()


def size(table: DataFrame, key: list[str]) -> DataFrame:
    """HASHTABLE-SIZE, HASHSET-SIZE; one row."""
    return keys(table, key).agg(F.count("*").alias("n"))


def to_alist(table: DataFrame, key: str, value: str) -> DataFrame:
    """HASHTABLE->ALIST: one array of pairs, for bounded tables."""
    return table.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("car"), F.col(value).alias("cdr")))).alias("alist"))


def from_alist(df: DataFrame, alist: str) -> DataFrame:
    """ALIST->HASHTABLE."""
    return df.select(F.explode(alist).alias("p")).select(F.col("p.car").alias("key"), F.col("p.cdr").alias("value"))


def skim(table: DataFrame, threshold, value: str = "value") -> DataFrame:
    """HASHTABLE-SKIM: keys whose value is at least the threshold."""
    return table.filter(F.col(value) >= threshold)


def maximal(table: DataFrame, value: str = "value") -> DataFrame:
    """HASHTABLE-MAX: all keys tied at the largest value."""
    top = table.agg(F.max(value).alias("_top"))  # one row
    return table.join(F.broadcast(top), table[value] == top["_top"]).drop("_top")


def map_(table: DataFrame, body: Column, name: str = "result") -> DataFrame:
    """HASHTABLE-MAP, HASHSET-MAP: the union of a function's results."""
    return table.select(body.alias(name)).distinct()


def accept(elements: DataFrame, hashset: DataFrame, on: list[str]) -> DataFrame:
    """HASHSET-ACCEPT, HASHSET-GET: elements in the set."""
    return elements.join(hashset.select(*on), on, "left_semi").distinct()


def filter_(elements: DataFrame, hashset: DataFrame, on: list[str]) -> DataFrame:
    """HASHSET-FILTER: elements not in the set."""
    return elements.join(hashset.select(*on), on, "left_anti").distinct()


def hashset(*parts: DataFrame) -> DataFrame:
    """MAKE-HASHSET, CHOICES->HASHSET, VALUES->HASHSET, HASHSET-ADD!, HASHSET-ELEMENTS, HASHSET-ELTS: distinct members."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def hashset_zap(members: DataFrame, gone: DataFrame) -> DataFrame:
    """HASHSET-ZAP!."""
    return members.join(gone, members.columns, "left_anti")


def hashset_contains(members: DataFrame, elements: DataFrame, on: list[str]) -> DataFrame:
    """HASHSET-CONTAINS?: whether any of the elements is in the set; one row."""
    return elements.join(members.select(*on), on, "left_semi").limit(1).agg((F.count("*") > 0).alias("contains"))


def hashtable(rows: DataFrame, key: str, value: str) -> DataFrame:
    """MAKE-HASHTABLE: (key, value) of the last row of each key by value order."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.max(value).alias("value"))


def intern(df: DataFrame, column: str) -> DataFrame:
    """HASHSET-INTERN: a dictionary of distinct values with portable hashes."""
    return df.select(column).distinct().withColumn("hash", F.xxhash64(column))


def statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """What accumulating loops over sets compute: n, sum, sum of squares, mean."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("sumsq"), F.avg(v).alias("mean"))
