"""Held-out recall and precision, quotation and reporting under a fitted scorer, and what fitting is bounded by."""

import pytest
from helpers import collected
from pyspark.sql import functions as F

from framesift.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, toxicity.train(docs, labels)


def test_recall_and_precision(fitted):
    docs, labels, scorer = fitted
    got = toxicity.score_documents(docs, scorer).join(labels, "doc_id").filter("held_out").select("toxic", "predicted").collect()
    toxic = [r for r in got if r.toxic == 1]
    assert len(toxic) >= 100 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in got if r.toxic == 0) <= 0.02 * (len(got) - len(toxic))


def test_use_scores_above_mention(spark, fitted):
    lead, tail = "They met near the old bridge and talked for long", "and then all of them went home by the river"
    clause = "you are a stupid idiot"
    rows = [(1, f"{lead} {clause} {tail}"), (2, f'{lead} "{clause}" {tail}'), (3, f"{lead} somebody said {clause} {tail}"), (4, f'{lead} somebody said "{clause}" {tail}'), (5, f"{lead} {tail}"), (6, ""), (7, None)]
    s = {r["doc_id"]: r["score"] for r in collected(toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), fitted[2]))}
    assert s[1] > s[2] and s[1] > s[3] > s[4] and min(s[1], s[2]) > s[5] and 0 <= s[6] == s[7] <= 1


def test_an_id_gives_one_text(spark, fitted):
    docs, labels, scorer = fitted
    first = labels.filter(~toxicity.held_out()).join(docs, "doc_id").limit(1).select("doc_id").first().doc_id
    again = docs.unionByName(docs.filter(F.col("doc_id") == first).withColumn("text", F.explode(F.array(*([F.col("text")] * 50)))))
    config = toxicity.ToxicityConfig()
    assert toxicity.training_rows(again, labels, config).count() == toxicity.training_rows(docs, labels, config).count()
    assert toxicity.train(again, labels).terms == scorer.terms


def test_empty_tables(spark, fitted):
    docs, labels, scorer = fitted
    assert toxicity.score_documents(docs.limit(0), scorer).count() == 0
    assert toxicity.train(docs.limit(0), labels).weights is None and toxicity.train(docs, labels.limit(0)).weights is None
