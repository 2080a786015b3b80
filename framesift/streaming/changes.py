"""Change feeds: keys changed since a stamp, and stores kept up to date from a stream of changes.

A change row has a monotone stamp, a key, an operation (add or drop) and a value.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import checkpoint_root


def changes_since(log: DataFrame, stamp: int, key: str = "key") -> DataFrame:
    """OID-CHANGES, ISERVER-CHANGES, IXSERVER-CHANGES: the keys changed after a stamp; a pushed-down predicate and a map-side distinct."""
    return log.filter(F.col("stamp") > stamp).select(key).distinct()


def needs_refresh(log: DataFrame, stamp: int) -> DataFrame:
    """GET-SYNCSTAMP: the last stamp, and whether the stamp is older than the oldest change that the log still holds, so that everything must be read again."""
    return log.agg((F.min("stamp") > F.lit(stamp) + 1).alias("refresh"), F.max("stamp").alias("syncstamp"))


def ring(log: DataFrame, size: int) -> DataFrame:
    """The last ``size`` stamps of the log, which is what a bounded log holds."""
    return log.join(F.broadcast(log.agg(F.max("stamp").alias("_max"))), F.col("stamp") > F.col("_max") - size).drop("_max")


def apply_changes(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows (key, value) after the changes: of each (key, value) the last operation counts."""
    w = Window.partitionBy("key", "value").orderBy(F.col("stamp").desc(), F.col("op").desc())
    last = changes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("key", "value", "op")
    kept = store.select("key", "value").join(last.select("key", "value"), ["key", "value"], "left_anti")
    return kept.unionByName(last.filter("op = 'add'").select("key", "value")).distinct()


def follow(spark: SparkSession, source_dir: str, schema, key: str, target: str) -> DataFrame:
    """SYNC, AUTOSYNC: read the files that are new since the last call and add up (key, n, last stamp) per batch.

    A stream with ``availableNow`` ends when the source is drained; its progress lies in a folder beside the target, and
    each batch is written under its own number, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.count("*").alias("n"), F.max("stamp").alias("stamp")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source_dir)
    stream.writeStream.option("checkpointLocation", f"{target}-progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(target).groupBy(key).agg(F.sum("n").alias("n"), F.max("stamp").alias("stamp"))


def scratch_target(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
