"""Files in and out: stored indices, snapshots, record streams, listings, feeds; and the shape of plans."""

from pyspark.sql import functions as F

from framesift.operators import choices, pools, search
from framesift.operators.frames import FrameStore
from framesift.operators.index import Index
from framesift.plans import frames as Q
from framesift.sources import records
from framesift.streaming import changes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_store(spark, tmp_path):
    ix = Index(spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("b", "y", 2)], "slot string, value string, oid long"))
    ix.write(str(tmp_path / "ix"))
    back = Index.open(spark, str(tmp_path / "ix"))
    assert sorted(map(tuple, back.postings.collect())) == [("a", "x", 1), ("b", "y", 2)]
    text = plan(back.get(("a", "x")))
    assert "PartitionFilters: [isnotnull(slot" in text and "EqualTo(value,x)" in text


def test_catalog(spark, tmp_path):
    import pytest

    from framesift.sources.stores import Catalog

    c = Catalog(spark, str(tmp_path / "stores"))
    assert c.names() == [] and not c.exists("p")
    one, two = spark.range(3).toDF("oid"), spark.range(5).toDF("oid")
    assert c.commit("p", one, sort_by=["oid"]) == 1 and c.cache("p").count() == 3
    assert c.commit("p", two) == 2 and c.open("p").count() == 5 and c.open("p", 1).count() == 3
    assert tuple(c.metadata("p").first()) == ("p", 2, 5, "oid") and c.names() == ["p"]
    c.set_read_only("p")
    with pytest.raises(PermissionError):
        c.commit("p", one)
    c.compact("p")
    assert c.versions("p") == [2]
    with pytest.raises(KeyError):
        c.open("p", 1)


def test_snapshot(spark, tmp_path):
    pool = spark.range(50).select(F.col("id").alias("oid"), F.lit("v").alias("value"))
    pools.snapshot(pool, str(tmp_path / "p"))
    back = pools.restore(spark, str(tmp_path / "p"))
    assert pools.diff(pool, back).count() == 0
    assert "GreaterThanOrEqual(oid,10)" in plan(back.filter(pools.in_pool(F.col("oid"), 10, 5)))


def test_record_files(spark, tmp_path):
    (tmp_path / "r.txt").write_text("one--two--three")
    assert sorted(r[0] for r in records.open_record_stream(spark, str(tmp_path / "r.txt"), "--").collect()) == ["one", "three", "two"]
    assert records.file_strings(spark, str(tmp_path / "r.txt")).first().text == "one--two--three"
    assert records.get_files(spark, str(tmp_path)).first().length == 15
    assert records.file_data(spark, str(tmp_path / "r.txt")).first().content == b"one--two--three"
    assert records.get_dirs(spark, str(tmp_path)).count() == 1


def test_feed_reads_only_new_files(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda a, b: spark.createDataFrame([(i, i % 2) for i in range(a, b)], "stamp long, key long")
    rows(0, 10).write.parquet(source)
    schema = rows(0, 1).schema
    assert {r.key: (r.n, r.stamp) for r in changes.follow(spark, source, schema, "key", target).collect()} == {0: (5, 8), 1: (5, 9)}
    rows(10, 13).write.mode("append").parquet(source)
    assert {r.key: (r.n, r.stamp) for r in changes.follow(spark, source, schema, "key", target).collect()} == {0: (7, 12), 1: (6, 11)}


def test_search_is_one_shuffle(spark, sf):
    ix = Index.index_frames(Q.parts(spark, sf))
    found = search.find_frames(Index(FrameStore.from_wide(spark.read.parquet(f"{sf}/part.parquet"), "p_partkey", ["p_brand", "p_type"]).slots), ("p_brand", ["Brand#1"]), ("p_type", ["PROMO"]))
    assert plan(found).count("Exchange") == 1
    assert "Window" not in plan(choices.largest(spark.read.parquet(f"{sf}/part.parquet"), F.col("p_size"), ["p_brand"]))
    assert "Cartesian" not in plan(search.scores_from_samples(ix, spark.createDataFrame([(3,)], "oid long")))
