"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again as the
next stage's docs. All stages but the last return the columns of ``documents``. An empty table goes through all of them;
null texts count as empty; texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import mixing, neardup, quality, secrets, sentencepieces
from framesift.llm.common import shared_table, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, empty ones among them; repeated rows are judged alike."""
    return quality.quality_verdicts(docs, keep=docs.columns).filter("kept").select("_keep.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id. Of rows with the same id and text one stays, and rows with
    the same id and other texts are documents of their own. Texts without words and rows without an id are in no group."""
    return neardup.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; no row goes, and rows without a secret stay as they are, null texts too."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it: not at all, once, or up to three times. Rows that share id and text
    are taken alike; a null source is a source."""
    taken = mixing.mix(docs, keep=docs.columns).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_keep.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row; null for a null text."""
    return sentencepieces.encode_documents(docs, MODEL).select("doc_id", "n_tokens", "input_ids", "round_trip")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("redact_secrets", redact_secrets), ("mix_sources", mix_sources), ("encode", encode)]
#: Tokens can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
