"""Stages of the pipeline on rows with nulls, empty and long texts, ties, repeats and columns of other tables."""

from collections import Counter

import pytest
from helpers import EDGES, collected, documents

from framesift.llm import mixing

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def odd(spark, sf):
    return documents(spark, sf).drop("_row").cache()


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in collected(df))


def test_quality_rules(spark, sf, odd):
    got = pairs(STAGES["quality_rules"](spark, odd, sf))
    edges = {e[:2] for e in EDGES}
    assert got and not edges & set(got) and set(got) <= set(pairs(odd))


def test_near_dedup(spark, sf, odd):
    edges = spark.createDataFrame([e[:5] for e in EDGES], "doc_id long, text string, lang string, source string, n_chars long")
    assert pairs(STAGES["near_dedup"](spark, edges, sf)) == Counter({e[:2] for e in EDGES} - {(900004, "A  B\n")})  # the words of 900003, twice
    two = spark.createDataFrame([(1, "one two three four five six", "en", "a", 27), (1, "completely other text that stands under this id", "en", "a", 47), (2, "One two three four five six", "en", "a", 27)], edges.schema)
    assert pairs(STAGES["near_dedup"](spark, two, sf)) == Counter([(1, "one two three four five six"), (1, "completely other text that stands under this id")])


def test_redact_secrets(spark, sf, odd):
    got = STAGES["redact_secrets"](spark, odd, sf)
    assert got.dtypes == odd.dtypes
    assert Counter(r["doc_id"] for r in collected(got)) == Counter(r["doc_id"] for r in collected(odd))
    edges = {e[:2] for e in EDGES}
    assert {k: n for k, n in pairs(got).items() if k in edges} == {k: n for k, n in pairs(odd).items() if k in edges}


def test_mix_sources(spark, sf, odd):
    want = Counter()
    for r in collected(mixing.mix(odd, keep=["text"])):
        want[r["doc_id"], r["_keep"].text] += r["copies"]
    assert pairs(STAGES["mix_sources"](spark, odd, sf)) == +want


def test_encode(spark, sf, odd):
    got = collected(STAGES["encode"](spark, odd, sf))
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in collected(odd))
    assert all(r["round_trip"] is not False for r in got) and sum(r["input_ids"] is None for r in got) == sum(r["text"] is None for r in collected(odd))


@pytest.mark.parametrize("name", list(STAGES))
def test_empty(spark, sf, odd, name):
    assert STAGES[name](spark, odd.limit(0), sf).count() == 0
