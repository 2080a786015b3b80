"""Stored pools and indices by name: versions in a folder, each written whole and visible only when complete.

A table's folder holds ``v=1``, ``v=2``, ...; the current version is the largest that Spark finished (it has a _SUCCESS
file). Writing never touches what readers use, so a lost writer leaves the last version in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    """USE-POOL, OPEN-INDEX, USE-INDEX, ALL-POOLS, ALL-INDICES over one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.read_only: set[str] = set()
        self.cached: dict[str, DataFrame] = {}

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def names(self) -> list[str]:
        """ALL-POOLS, ALL-INDICES, GET-POOLS."""
        return [n for n in self._names(self.root) if self.versions(n)]

    def versions(self, name: str) -> list[int]:
        found = []
        for v in self._names(f"{self.root}/{name}"):
            fs, done = self._fs(f"{self.root}/{name}/{v}/_SUCCESS")
            if v.startswith("v=") and fs.exists(done):
                found.append(int(v[2:]))
        return sorted(found)

    def exists(self, name: str) -> bool:
        """POOL?, INDEX?, FILE-POOL?, FILE-INDEX?, REGISTERED-SUPER-POOL?."""
        return bool(self.versions(name))

    def open(self, name: str, version: int | None = None) -> DataFrame:
        """OPEN-POOL, OPEN-INDEX, SYNC-POOL, SYNC-INDEX, SYNC-INDICES, SYNC-ALL, REVERT-POOL, REVERT-INDEX, REVERT-INDICES,
        REVERT-OID, RECOVER-POOL: what was committed last, or an older version."""
        if version is None and name in self.cached:
            return self.cached[name]
        known = self.versions(name)
        if not known or (version is not None and version not in known):
            raise KeyError(f"{name} has no version {version if version is not None else ''}".strip())
        return self.spark.read.parquet(f"{self.root}/{name}/v={version or known[-1]}")

    def is_writable(self, name: str) -> bool:
        """POOL-WRITABLE?, INDEX-WRITABLE?, WRITABLE?, ISERVER-WRITABLE?, IXSERVER-WRITABLE?."""
        return name not in self.read_only

    def set_read_only(self, name: str, flag: bool = True) -> None:
        """SET-POOL-READ-ONLY!, SET-INDEX-READ-ONLY!, NEVER-SAVE!."""
        (self.read_only.add if flag else self.read_only.discard)(name)

    def commit(self, name: str, df: DataFrame, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> int:
        """COMMIT-POOL, COMMIT-INDEX, COMMIT-OID, RESET-FILE-POOL, WRITE-DATA, WRITE-TO-FILE: a new version."""
        if not self.is_writable(name):
            raise PermissionError(f"{name} is read-only")
        number = max([0, *self.versions(name)]) + 1
        if sort_by:
            df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/v={number}")
        self.swap_out(name)
        return number

    def metadata(self, name: str) -> DataFrame:
        """FILE-POOL-METADATA, FILE-INDEX-METADATA, POOL-LOAD: name, version, rows and columns, in one row."""
        df = self.open(name)
        return df.agg(F.lit(name).alias("name"), F.lit(self.versions(name)[-1]).alias("version"), F.count("*").alias("rows"), F.lit(",".join(df.columns)).alias("columns"))

    def cache(self, name: str) -> DataFrame:
        """CACHE-POOL, CACHE-INDEX, INDEX-CACHE, PRELOAD-INDEX!, AUTO-CACHE-FILE-POOLS, AUTO-CACHE-FILE-INDICES, ENABLE-SLOT-CACHE!."""
        if name not in self.cached:
            self.cached[name] = self.open(name).cache()
        return self.cached[name]

    def swap_out(self, name: str | None = None) -> None:
        """SWAP-OUT, SWAP-OUT-POOL, SWAP-OUT-POOLS, SWAP-OUT-INDEX, SWAP-OUT-INDICES, SWAP-OUT-ALL, UNPRELOAD-INDEX!, CLOSE-POOL,
        CLOSE-INDEX, CLEAR-SLOT-CACHE!, DISABLE-SLOT-CACHE!."""
        for n in [name] if name else list(self.cached):
            if n in self.cached:
                self.cached.pop(n).unpersist()

    def compact(self, name: str, keep: int = 1) -> None:
        """repack, LABEL-POOL!: older versions go; the last ``keep`` stay."""
        for v in self.versions(name)[: -keep or None]:
            fs, p = self._fs(f"{self.root}/{name}/v={v}")
            fs.delete(p, True)
