"""Inverted indices: postings (slot, value, oid), without repeats.

An index is meant to be stored partitioned by slot and bucketed or sorted by value: a lookup then reads one partition
with pushed-down predicates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import FrameStore

POSTINGS = ["slot", "value", "oid"]


class Index:
    def __init__(self, postings: DataFrame):
        self.postings = postings.select(*POSTINGS)

    @staticmethod
    def index_frames(store: FrameStore, slots: list[str] | None = None, stop_slots: tuple[str, ...] = (), expanders: dict[str, callable] | None = None) -> Index:
        """INDEX-FRAME, INDEX!, USE-AUTOINDEX!: stop slots are skipped only where slots aren't named; expanders map a value
        column to an array of values."""
        rows = store.slots.filter(~F.col("slot").isin(*stop_slots)) if slots is None and stop_slots else store.slots if slots is None else store.slots.filter(F.col("slot").isin(*slots))
        if expanders:
            expanded = F.array("value")
            for slot, f in expanders.items():
                expanded = F.when(F.col("slot") == slot, f(F.col("value"))).otherwise(expanded)
            rows = rows.select("oid", "slot", F.explode(expanded).alias("value"))
        return Index(rows.select(*POSTINGS).distinct())

    @staticmethod
    def index_values(rows: DataFrame) -> Index:
        """INDEX-VALUES: explicit (slot, value, oid); expanders don't apply."""
        return Index(rows.select(*POSTINGS).distinct())

    @staticmethod
    def compound(*indices: Index) -> Index:
        """OPEN-COMPOUND-INDEX: the union of postings."""
        return Index(reduce(lambda a, b: a.unionByName(b), (i.postings for i in indices)))

    def get(self, *keys: tuple[str, str]) -> DataFrame:
        """INDEX-GET, ISERVER-GET, ISERVER-BULK-GET, IXSERVER-GET, IXSERVER-BULK-GET: oids under any of the keys (slot, value)."""
        hit = reduce(lambda a, b: a | b, ((F.col("slot") == s) & (F.col("value") == str(v)) for s, v in keys))
        return self.postings.filter(hit).select("oid").distinct()

    def get_size(self, slots: list[str] | None = None) -> DataFrame:
        """INDEX-GET-SIZE, ISERVER-GET-SIZE, IXSERVER-GET-SIZE: postings per key; over a compound index sizes add up without removing repeats."""
        rows = self.postings if slots is None else self.postings.filter(F.col("slot").isin(*slots))
        return rows.groupBy("slot", "value").agg(F.count("*").alias("n"))

    def keys(self) -> DataFrame:
        """INDEX-KEYS, ISERVER-KEYS, IXSERVER-KEYS."""
        return self.postings.select("slot", "value").distinct()

    def add(self, keys: DataFrame, oids: DataFrame) -> Index:
        """INDEX-ADD!, ISERVER-ADD!, IXSERVER-ADD!: each of a set of keys (slot, value) gets each of the oids."""
        return Index(self.postings.unionByName(keys.crossJoin(oids.select("oid")).select(*POSTINGS)).distinct())

    def add_rows(self, rows: DataFrame) -> Index:
        """ISERVER-BULK-ADD!, IXSERVER-BULK-ADD!."""
        return Index(self.postings.unionByName(rows.select(*POSTINGS)).distinct())

    def drop(self, rows: DataFrame) -> Index:
        """INDEX-DROP!, ISERVER-DROP!, IXSERVER-DROP!."""
        return Index(self.postings.join(rows.select(*POSTINGS), POSTINGS, "left_anti"))

    def zap(self, keys: DataFrame) -> Index:
        """INDEX-ZAP!."""
        return Index(self.postings.join(keys.select("slot", "value").distinct(), ["slot", "value"], "left_anti"))

    def set_(self, rows: DataFrame) -> Index:
        """INDEX-SET!."""
        return Index(self.zap(rows).postings.unionByName(rows.select(*POSTINGS).distinct()))

    def prefetch(self, keys: DataFrame) -> DataFrame:
        """INDEX-PREFETCH: the postings of a table of keys."""
        return self.postings.join(keys.select("slot", "value").distinct(), ["slot", "value"], "left_semi")

    def size(self) -> DataFrame:
        """INDEX-SIZE, INDEX-COUNT, INDEX-LOAD: keys and postings."""
        return self.get_size().agg(F.count("*").alias("keys"), F.sum("n").alias("postings"))

    def histogram(self) -> DataFrame:
        """analyze-index: how many keys have how many values."""
        return self.get_size().groupBy(F.col("n").alias("values")).agg(F.count("*").alias("keys"))

    def above(self, threshold: int) -> DataFrame:
        """SET-INDEX-THRESHOLD!: keys with more postings than the threshold."""
        return self.get_size().filter(F.col("n") > threshold)

    def features(self) -> DataFrame:
        """FRAME-FEATURES per oid."""
        return self.postings.select("oid", "slot", "value")

    def write(self, path: str, buckets: int | None = None) -> None:
        """MAKE-FILE-INDEX, COMMIT-INDEX, COMMIT-INDICES, repack: partitioned by slot, sorted by value, without repeats."""
        rows = self.postings.distinct()
        rows = rows.repartition(buckets, "slot", "value") if buckets else rows.repartition("slot", "value")
        rows.sortWithinPartitions("slot", "value", "oid").write.mode("overwrite").partitionBy("slot").parquet(path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        """OPEN-INDEX, USE-INDEX, SYNC-INDEX, REVERT-INDEX: what the store holds."""
        return Index(spark.read.parquet(path))
