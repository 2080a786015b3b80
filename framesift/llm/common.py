"""Helpers shared by the training-data operators: tables, let-bindings, shared scratch tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import checkpoint_root, shared_table

__all__ = ["WS", "checkpoint_root", "let", "n_words", "shared_table", "spread", "table", "words"]
#: White space that separates words, as a Java character class body.
WS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table in few files, dealt to all cores; any other table as it is.

    A scan gives one task per file or per ``spark.sql.files.maxPartitionBytes``. Where that would leave cores idle, the
    table is under that size for each core, so dealing it out costs little; larger tables are never dealt anew.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    at_most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if size < cores * min(at_most, 1 << 27) else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` may use it many times at the cost of one evaluation."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WS}]", -1), lambda x: x != F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    return F.size(words(text)).cast("long")
