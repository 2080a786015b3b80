"""Operators that must be native run no Python on the executors, join nothing by nested loops and sort nothing whole."""

import re

import pytest

from framesift.llm import licenses, mixing, quality, queries, secrets


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_secret_scans", "op7_license_scans", "op8_mixing"])
def test_no_python(spark, sf, name):
    text = plan(queries.QUERIES[name](spark, sf))
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", text)


def test_no_python_before_scratch_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (quality.document_stats(docs), secrets.scan_rows(docs), mixing.sized(docs), secrets.linked(secrets.scan_rows(docs))):
        assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan(df))


def test_only_needed_columns_are_read(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(secrets.scan_rows(docs))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan(queries.op10_url_filters(spark, sf))


def test_no_texts_are_shuffled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = plan(licenses.scan_licenses(docs))
    assert "words" not in "".join(x for x in text.split("\n") if "Exchange" in x and "Broadcast" not in x) and "text" not in text
    assert "Exchange" not in plan(quality.quality_verdicts(docs))


def test_any_number_of_templates_is_one_join(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    templates = [licenses.Template(f"l{i}", [f"a{i}", f"b{i}", f"c{i}", f"d{i}", f"e{i}"], 4, 7) for i in range(500)]
    rows = docs.selectExpr("doc_id _row", "0L at", "split(text, ' ') words")
    text = plan(licenses.matches(rows, templates))
    assert len(re.findall("Join", text)) <= 2 and not re.search("NestedLoop|Cartesian|Python", text)
