"""Nearest neighbours against brute force, and the pipeline and entry on the small table."""

import numpy as np
import pytest
from helpers import collected
from pyspark.sql import functions as F

from framesift.llm import neighbours, queries


def brute(rows, asked, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in ok:
        if not asked(q):
            continue
        found = set()
        for i, y in ok:
            if i != q and len(x) == len(y):
                s = 0.0
                for a, b in zip(x.tolist(), y.tolist()):
                    s += a * b
                found.add((-s, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(set(out))


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in collected(df))


@pytest.mark.parametrize("block,lanes", [(64, 3), (1000, 8)])
def test_nearest(spark, sf, block, lanes):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 400").select("vec_id", "embedding")
    odd = [(100000, None), (100020, [0.0] * 64), (100040, [float("nan")] * 64), (100060, [None] + [1.0] * 63), (100080, [1.0, 2.0]), (100081, [3.0, 4.0]), (100100, []), (None, [1.0] * 64), (7, [0.5] * 64), (60000, [float("inf")] * 64)]
    ties = [(200000 + i, [0.25] * 64) for i in range(60)]
    df = table.unionByName(spark.createDataFrame(odd + ties, "vec_id long, embedding array<float>")).withColumn("dim", F.lit(1))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = rows_of(neighbours.nearest(df, F.col("vec_id") % 20 == 0, neighbours.NeighbourConfig(block=block, query_block=block, lanes=lanes)))
    assert got == brute(rows, lambda q: q % 20 == 0, 20)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert rows_of(neighbours.nearest(df, F.col("vec_id") % 20 == 0)) == [(0, 1, 1, 0.5)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_quantisation_bounds_hold():
    g = np.random.default_rng(1)
    x, y = g.normal(size=(200, 32)) * 10, g.normal(size=(200, 32)) / 7
    sides = []
    for m in (x, y):
        scale = np.abs(m).max(axis=1) / 127
        codes = np.rint(m / scale[:, None]).astype(np.int8)
        sides.append((codes, scale, *neighbours._error(codes, scale, m)))
    (ca, sa, na, ea), (cb, sb, nb, eb) = sides
    near = (ca.astype(float) @ cb.astype(float).T) * sa[:, None] * sb[None, :]
    slack = na[:, None] * eb + ea[:, None] * (nb + eb)
    assert (np.abs(near - x @ y.T) <= slack + 1e-12).all()


def test_pipeline(spark, sf):
    import corpus_pipeline

    names = {"doc_id", "text", "lang", "source", "n_chars"}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert set(docs.columns) == names, name
        n.append(docs.count())
    assert n[0] > n[1] > n[2] == n[3] > 0
    assert docs.filter(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == n[4] and out.filter("not round_trip").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf, duck, name):
    from compare import rows

    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
