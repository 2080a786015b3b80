"""Pools and object ids: ranges of ids with their values, allocation, snapshots and differences.

A pool is a DataFrame with oid and value columns; its catalog row is (base, capacity, label).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_table


def catalog(spark: SparkSession, rows: list[tuple[int, int, str]]) -> DataFrame:
    """USE-POOL, ALL-POOLS, GET-POOLS, NAME->POOL, POOL-LABEL, POOL-ID: (base, capacity, label) of the registered pools."""
    return spark.createDataFrame(rows, "base long, capacity long, label string")


def in_pool(oid: Column, base: int, capacity: int) -> Column:
    """IN-POOL?: a pushed-down range predicate."""
    return (oid >= base) & (oid < base + capacity)


def get_pool(oids: DataFrame, pools: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """GET-POOL: (oid, label) by equal range buckets and an exact range test, so no nested loops."""
    o = oids.select("oid").distinct().withColumn("_b", F.floor(F.col("oid") / bucket))
    p = pools.withColumn("_b", F.explode(F.sequence(F.floor(F.col("base") / bucket), F.floor((F.col("base") + F.col("capacity") - 1) / bucket))))
    return o.join(p, "_b").filter((F.col("oid") >= F.col("base")) & (F.col("oid") < F.col("base") + F.col("capacity"))).select("oid", "label")


def in_same_pool(pairs: DataFrame, pools: DataFrame) -> DataFrame:
    """IN-SAME-POOL?: (a, b, same)."""
    ids = get_pool(pairs.select(F.col("a").alias("oid")).unionByName(pairs.select(F.col("b").alias("oid"))), pools)
    x, y = ids.select(F.col("oid").alias("a"), F.col("label").alias("_x")), ids.select(F.col("oid").alias("b"), F.col("label").alias("_y"))
    return pairs.join(x, "a", "left").join(y, "b", "left").select("a", "b", F.coalesce(F.col("_x") == F.col("_y"), F.lit(False)).alias("same"))


def contents(pool: DataFrame) -> DataFrame:
    """POOL-CONTENTS, POOL-ELTS, DO-POOL."""
    return pool.select("oid").distinct()


def statistics(pool: DataFrame, capacity: int) -> DataFrame:
    """POOL-BASE, POOL-LOAD, POOL-CAPACITY, POOL-FREESPACE; one row."""
    return contents(pool).agg(F.min("oid").alias("base"), F.count("*").alias("load"), F.lit(capacity).cast("long").alias("capacity"), (F.lit(capacity).cast("long") - F.count("*")).alias("freespace"))


def oid_value(pool: DataFrame, oids: DataFrame) -> DataFrame:
    """OID-VALUE, FETCH-OIDS, LOAD-OID, PREFETCH, POOL-DATA."""
    return pool.join(oids.select("oid").distinct(), "oid", "left_semi")


def set_oid_value(pool: DataFrame, rows: DataFrame) -> DataFrame:
    """SET-OID-VALUE!, STORE-OID-VALUE!, BULK-COMMIT."""
    return pool.join(rows.select("oid").distinct(), "oid", "left_anti").unionByName(rows.select(*pool.columns))


def allocate(rows: DataFrame, base: int) -> DataFrame:
    """ALLOCATE-OID, NEW-OID, NEW-FRAME: contiguous ids from ``base``, without sorting or one partition for all.

    Rows are numbered inside partitions, and partitions' counts (a few numbers per partition) give their offsets.
    """
    held = shared_table(rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    # ids of one partition grow by one from the partition's first
    counts = held.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("lo")).orderBy("_p").collect()
    at, starts = base, []
    for c in counts:
        starts.append((c["_p"], at - c["lo"]))
        at += c["n"]
    shift = F.create_map(*(F.lit(x) for s in starts for x in s)) if starts else F.create_map(F.lit(0), F.lit(0))
    return held.withColumn("oid", F.col("_i") + F.element_at(shift, F.col("_p"))).drop("_p", "_i")


def random_oid(pool: DataFrame, seed: int = 0) -> DataFrame:
    """RANDOM-OID: one id, fixed by the seed."""
    return contents(pool).orderBy(F.xxhash64(F.lit(seed), "oid"), "oid").limit(1)


def make_oid(hi: Column, lo: Column) -> Column:
    return F.shiftleft(hi.cast("long"), 32).bitwiseOR(lo.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def oid_high(oid: Column) -> Column:
    """OID-ADDR-HIGH."""
    return F.shiftrightunsigned(oid, 32)


def oid_low(oid: Column) -> Column:
    """OID-ADDR-LOW."""
    return oid.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def oid_plus(oid: Column, offset) -> Column:
    return oid + offset


def oid_difference(a: Column, b: Column) -> Column:
    return a - b


def compare_oids(a: Column, b: Column) -> Column:
    """COMPARE-OIDS: -1, 0 or 1."""
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))


def snapshot(pool: DataFrame, path: str) -> None:
    """MAKE-POOL-SNAPSHOT, MAKE-FILE-POOL, COMMIT-POOL, COMMIT-POOLS, COMMIT-ALL: a copy by id ranges, so later id predicates prune row groups."""
    pool.repartitionByRange("oid").sortWithinPartitions("oid").write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """RESTORE-POOL-SNAPSHOT, OPEN-POOL, REVERT-POOL, REVERT-POOLS, REVERT-ALL, SYNC-POOL, SYNC-POOLS, SYNC-ALL."""
    return spark.read.parquet(path)


def diff(old: DataFrame, new: DataFrame, value: str = "value") -> DataFrame:
    """pool-diff, compare-file-pools: (oid, change) with change in added, dropped, modified. One full outer join."""
    a = old.select("oid", F.col(value).alias("_a"), F.lit(1).alias("_ina"))
    b = new.select("oid", F.col(value).alias("_b"), F.lit(1).alias("_inb"))
    both = a.join(b, "oid", "full")
    change = F.when(F.col("_ina").isNull(), "added").when(F.col("_inb").isNull(), "dropped").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return both.withColumn("change", change).filter("change is not null").select("oid", "change")


def adjunct(pool: DataFrame, slots: list[DataFrame]) -> DataFrame:
    """REGISTER-ADJUNCT!: slots kept in tables of their own, put beside the pool by id."""
    return reduce(lambda a, b: a.join(b, "oid", "left"), slots, pool)


def allocate_ranges(super_pool: tuple[int, int], load: int, sizes: list[tuple[str, int]]) -> list[tuple[int, int, str]]:
    """MAKE-SUPER-POOL, SUPER-POOL-BASE, SUPER-POOL-TOP, SUPER-POOL-LOADING, ALLOCATE-FROM-SUPER-POOL, ALLOCATE-POOL: catalog rows of new pools, one after the other in the super pool's range (base, top)."""
    base, top = super_pool
    at, out = base + load, []
    for label, capacity in sizes:
        if at + capacity > top:
            raise ValueError(f"no room for {label}")
        out.append((at, capacity, label))
        at += capacity
    return out
