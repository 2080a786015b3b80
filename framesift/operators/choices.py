"""Choices (sets) as DataFrames: rows are elements, without repeats. Everything is lazy and distributed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def choice(*sets: DataFrame) -> DataFrame:
    """CHOICE, AMB, EITHER, UNION. One shuffle for all arguments, after a map-side distinct."""
    return reduce(lambda a, b: a.unionByName(b), sets).distinct()


def intersection(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """INTERSECTION, INTERSECTOR: chained semi joins on all columns (null-safe); an empty argument empties the result."""
    return reduce(lambda a, b: a.intersect(b.select(*a.columns)), rest, first).distinct()


def difference(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """DIFFERENCE, by sets: one anti join against the union of the rest."""
    if not rest:
        return first.distinct()
    return first.subtract(reduce(lambda a, b: a.unionByName(b), (r.select(*first.columns) for r in rest)))


def identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """IDENTICAL?: one row, one boolean."""
    cols = [F.col(f"`{c}`") for c in a.columns]
    sides = a.distinct().withColumn("_s", F.lit(1)).unionByName(b.select(*a.columns).distinct().withColumn("_s", F.lit(2)))
    odd = sides.groupBy(*cols).agg(F.sum("_s").alias("_s")).filter("_s <> 3")
    return odd.agg((F.count("*") == 0).alias("identical"))


def contains(a: DataFrame, b: DataFrame) -> DataFrame:
    """CONTAINS?: whether every element of a is in b; one row."""
    return difference(a, b).agg((F.count("*") == 0).alias("contains"))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """OVERLAPS?; one row."""
    return intersection(a, b).limit(1).agg((F.count("*") > 0).alias("overlaps"))


def try_(by: list[str], *alternatives: DataFrame) -> DataFrame:
    """TRY per key: the rows of the first alternative that has any for the key."""
    out = alternatives[0]
    for nxt in alternatives[1:]:
        out = out.unionByName(nxt.join(out.select(*by).distinct(), by, "left_anti"))
    return out


def try_whole(*alternatives: DataFrame) -> DataFrame:
    """TRY of whole sets: the first that is not empty; tests emptiness only, one row at most of each."""
    for a in alternatives[:-1]:
        if not a.isEmpty():
            return a
    return alternatives[-1]


def exists(df: DataFrame, sub: DataFrame, on: list[str], *tests: Column) -> DataFrame:
    """EXISTS: rows for which ``sub`` has a row that passes every test."""
    return df.join(reduce(lambda a, t: a.filter(t), tests, sub).select(*on), on, "left_semi")


def not_exists(df: DataFrame, sub: DataFrame, on: list[str], *tests: Column) -> DataFrame:
    """EMPTY?, FAIL?."""
    return df.join(reduce(lambda a, t: a.filter(t), tests, sub).select(*on), on, "left_anti")


def filter_choices(df: DataFrame, *tests: Column) -> DataFrame:
    return reduce(lambda a, t: a.filter(t), tests, df)


def count_choices(df: DataFrame, *tests: Column) -> DataFrame:
    """COUNT-CHOICES: one row; every aggregate is partial first."""
    return df.agg(F.count_if(reduce(lambda a, t: a & t, tests, F.lit(True))).alias("n"))


def for_choices(df: DataFrame, body: Column, name: str = "value") -> DataFrame:
    """FOR-CHOICES: the union of what the body (an array) gives."""
    return df.select(F.explode(body).alias(name)).distinct()


def choice_size(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """CHOICE-SIZE, SET-SIZE per key. A distinct row shuffle first, then a partial count: no per-key buffer."""
    return df.select(*by, value).filter(F.col(value).isNotNull()).distinct().groupBy(*by).agg(F.count("*").alias("n"))


def singleton(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """SINGLETON per key: min = max instead of a set, so partial aggregates stay two values wide."""
    g = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    return g.filter("_a = _b").select(*by, F.col("_a").alias(value))


def smallest(df: DataFrame, key: Column, by: list[str] | None = None) -> DataFrame:
    """SMALLEST: every row whose key is least, ties kept: a partial minimum joined back, not a sorted window."""
    return _extreme(df, key, by, F.min)


def largest(df: DataFrame, key: Column, by: list[str] | None = None) -> DataFrame:
    return _extreme(df, key, by, F.max)


def _extreme(df: DataFrame, key: Column, by: list[str] | None, agg: Callable) -> DataFrame:
    keyed = df.withColumn("_k", key)
    if not by:
        best = keyed.agg(agg("_k").alias("_best"))  # one row
        return keyed.join(F.broadcast(best), keyed["_k"] == best["_best"]).select(*df.columns)
    best = keyed.groupBy(*by).agg(agg("_k").alias("_best"))
    best = best.select(*(F.col(c).alias(f"_by_{c}") for c in by), "_best")
    on = reduce(lambda a, c: a & keyed[c].eqNullSafe(best[f"_by_{c}"]), by, keyed["_k"] == best["_best"])
    return keyed.join(best, on).select(*df.columns)


def sorted_(df: DataFrame, *keys: Column) -> DataFrame:
    """SORTED, SORTBY: a total sort by range partitions. For the cross-type order use ``functions.order.order_key``."""
    return df.orderBy(*keys)


def top(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """(subseq (sorted ...) 0 n): a heap of n rows per task, merged."""
    return df.orderBy(*keys).limit(n)


def pick_n(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """PICK-N, PICK-ONE: n distinct random elements (all if fewer). A hash of seed and row stands for chance, so reruns agree."""
    return df.distinct().orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(n)


def pick_n_by(df: DataFrame, by: list[str], n: int, seed: int = 0) -> DataFrame:
    """PICK-N per key. Row numbers up to n are limited inside the partitions before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns)
    return df.distinct().withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def elements(df: DataFrame, seq: str, name: str = "element") -> DataFrame:
    """ELEMENTS, ELTS, SEQ->CHOICE."""
    return df.select(F.explode(seq).alias(name)).filter(F.col(name).isNotNull()).distinct()


def choices_to_vector(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """CHOICES->VECTOR, QUOTED-CHOICE per key: a sorted set in one value. For bounded sets only: the set is one row."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias(value))


def mp_call(f: Callable[..., Column], name: str, *args: tuple[DataFrame, str]) -> DataFrame:
    """MPCALL and auto-mapping: a function over the cross product of its argument sets; an empty set prunes the call."""
    crossed = reduce(lambda a, b: a.crossJoin(b), (df.select(c).distinct() for df, c in args))
    return crossed.select(f(*(F.col(c) for _, c in args)).alias(name)).distinct()


def do_results(df: DataFrame, body: Callable, schema: str) -> DataFrame:
    """DO-CHOICES, DO-RESULTS: a body over batches of rows; prefetching is the scan's."""
    return df.mapInPandas(body, schema)


def parallel(*bodies: Callable[[], DataFrame]) -> DataFrame:
    """PARALLEL, SPAWN: bodies run as Spark jobs at the same time, and their results are united.

    Each body's result is cached by its own thread, so the union reads what is there.
    """
    from concurrent.futures import ThreadPoolExecutor

    def run(body: Callable[[], DataFrame]) -> DataFrame:
        df = body().cache()
        df.foreachPartition(lambda _: None)
        return df

    with ThreadPoolExecutor(max_workers=len(bodies)) as pool:
        return choice(*pool.map(run, bodies))


def nd_call(df: DataFrame, by: list[str], value: str, f: Callable[[Column], Column], name: str) -> DataFrame:
    """NDCALL: a function of the whole set of each key."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("_s")).select(*by, f(F.col("_s")).alias(name))


class CallCache:
    """CACHECALL, CACHECALL1, CACHECALL-KEY, CACHECALL-CLEAR!, CACHECALL-CLEAR-ALL!, SCACHE: results of calls that give
    DataFrames, cached by function and arguments."""

    def __init__(self) -> None:
        self.held: dict[tuple, DataFrame] = {}

    def call(self, f: Callable[..., DataFrame], *args, key=None) -> DataFrame:
        k = (f, key if key is not None else args)
        if k not in self.held:
            self.held[k] = f(*args).cache()
        return self.held[k]

    def clear(self, f: Callable | None = None) -> None:
        for k in [k for k in self.held if f is None or k[0] is f]:
            self.held.pop(k).unpersist()
