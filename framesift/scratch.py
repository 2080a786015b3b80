"""Scratch tables in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Without it, a local session gets a folder of its own; a cluster, whose
    machines share no local folder, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file:///tmp/checkpoints/framesift"


def shared_table(df: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives the loss of any executor.

    The files are Parquet, so later readers prune columns and know true sizes. They go when the driver exits.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/framesift-{uuid.uuid4().hex}"
    schema = df.schema
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended already; the folder is scratch space
        return
