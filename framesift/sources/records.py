"""Record streams, whole-file reads and directory listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_record_stream(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """OPEN-RECORD-STREAM, READ-RECORD with a literal separator: splittable, one row per record."""
    return spark.read.text(path, lineSep=separator).withColumnRenamed("value", "record")


def records(df: DataFrame, text: str, pattern: str, keep: list[str]) -> DataFrame:
    """READ-RECORD, READ-SPACING, RECORD-STREAM-DATA with a pattern: (keep..., position, record, spacing); spacing is the separator before the record."""
    pieces = F.split(text, pattern, -1)
    seps = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
    both = F.arrays_zip(pieces.alias("record"), seps.alias("spacing"))
    return df.select(*keep, F.posexplode(both).alias("position", "r")).select(*keep, "position", "r.record", "r.spacing").filter("record <> ''")


def file_strings(spark: SparkSession, path: str) -> DataFrame:
    """FILESTRING: (path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def file_data(spark: SparkSession, path: str) -> DataFrame:
    """FILEDATA: (path, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def get_files(spark: SparkSession, path: str) -> DataFrame:
    """GETFILES: (path, length), without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def get_dirs(spark: SparkSession, path: str) -> DataFrame:
    """GETDIRS: directories that hold files."""
    return get_files(spark, path).select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
