"""Thin queries over the operators of this subpackage, as (spark, sf_dir) -> DataFrame, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, mixing, neardup, neighbours, pages, quality, secrets, sentencepieces, toxicity, urls
from .common import spread, table
from .oracles import ORACLES


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in secrets.BASE), F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir, "doc_id", "text")).drop("blocks")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(spread(table(spark, sf_dir, "pages"))).withColumn("n_chars", F.length("text").cast("long"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


#: Where the public tokenizer files lie; a parameter of the operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepieces.encode_documents(documents(spark, sf_dir, "doc_id", "text"), MODEL, parity_every=1)
    return found.select("doc_id", "n_tokens", "n_bytes_fallback", sentencepieces.ids_digest().alias("ids_sha256"), "round_trip", "parity")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_toxicity, op3_secret_scans, op4_html_extraction, op5_minhash_near_dedup,
        op6_sentencepiece, op7_license_scans, op8_mixing, op9_nearest_neighbours, op10_url_filters,
    )
}
__all__ = ["ORACLES", "QUERIES"]
