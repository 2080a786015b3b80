"""Exact nearest neighbours by a block matrix join with int8 product tiles.

Rows are packed into blocks: int8 codes with a scale per vector, and the original floats. Query blocks meet candidate
blocks cell by cell. A tile multiplies codes (as float32 matrix products, exact for these integers), which gives every
inner product up to a known quantisation error; only candidates whose upper bound reaches the query's k-th best lower
bound are recomputed in double precision and pushed to the query's heap. A task runs over all candidate blocks of its
lane for one query block, so a query leaves it with k rows, and the lanes' heaps are merged by a grouped top-k.

Nothing is approximate in the result: the bounds are strict, so every true neighbour survives. Cases: vectors that are
null, zero, or hold null or non-finite components take no part (nor do they query); vectors of different lengths are not
comparable and live in different blocks; ties go to the smaller id; a query's own id is no candidate, so repeated rows
of it neither; another id's repeated rows count once; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table


@dataclass(frozen=True)
class NeighbourConfig:
    k: int = 20
    #: Vectors in a block of candidates, and of queries: the larger the latter, the fewer times candidates are dealt.
    block: int = 1024
    query_block: int = 4096
    #: Lanes that share the candidate blocks of a query block.
    lanes: int = 8


#: Up to so many query blocks, their list (16 MB then) is broadcast.
FEW_BLOCKS = 1_000_000
BLOCK = "dim int, block long, blob binary"


def _usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one length, as pickled (ids, floats, codes, scales)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        at = [0]

        def out(dim: int) -> pd.DataFrame:
            ids = np.array([i for i, _ in held[dim]], np.int64)
            x = np.stack([v for _, v in held.pop(dim)])
            scale = np.abs(x.astype(np.float64)).max(axis=1) / 127
            codes = np.rint(x / scale[:, None]).astype(np.int8)
            at[0] += 1
            name = (TaskContext.get().partitionId() << 32) + at[0]  # ids may repeat, so no id can name a block
            return pd.DataFrame({"dim": [dim], "block": [name], "blob": [pickle.dumps((ids, x, codes, scale), protocol=5)]})

        for batch in batches:
            for i, v in zip(batch["vec_id"], batch["embedding"]):
                v = np.asarray(v)  # as given: single precision stays so until it is multiplied
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return rows.select("vec_id", "embedding").mapInPandas(pack, BLOCK)


def _error(codes: np.ndarray, scale: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the quantised vectors, and of what quantisation changed (rounded up)."""
    x, near = x.astype(np.float64), codes * scale[:, None]
    return np.sqrt((near * near).sum(1)) * (1 + 1e-9), np.sqrt(((x - near) ** 2).sum(1)) * (1 + 1e-9) + 1e-300


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products in double precision, components added in order."""
    q, c, total = q.astype(np.float64), c.astype(np.float64), np.zeros(len(c))
    for d in range(len(q)):
        total += q[d] * c[:, d]
    return total


def _bar(low: np.ndarray, firsts: np.ndarray | None, k: int) -> float:
    """The k-th largest lower bound, of which an id counts once; ``low`` is sorted by id where ``firsts`` is given."""
    if firsts is not None:
        low = np.maximum.reduceat(low, firsts)
    return np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf


def _tiles(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by query block; a query block row (side 0) is followed by its candidate blocks (side 1)."""
    cell, queries, heaps = None, None, None

    def result() -> pd.DataFrame:
        rows = [(int(q), c, s) for q, h in zip(queries[0], heaps) for s, c in ((s, -m) for s, m in h)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    for batch in batches:
        for dim, qblock, lane, side, blob in zip(batch["dim"], batch["qblock"], batch["lane"], batch["side"], batch["blob"]):
            if side == 0:
                if heaps is not None and any(heaps):
                    yield result()
                cell, queries = (dim, qblock, lane), pickle.loads(blob)
                qnorm, qerr = _error(queries[2], queries[3], queries[1])
                heaps = [[] for _ in queries[0]]
                qcodes = queries[2].astype(np.float32)
                continue
            if cell != (dim, qblock, lane):
                continue
            ids, x, codes, scale = pickle.loads(blob)
            by_id = np.argsort(ids, kind="stable")
            ids, x, codes, scale = ids[by_id], x[by_id], codes[by_id], scale[by_id]
            firsts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            if len(firsts) == len(ids):
                firsts = None  # no id repeats
            norm, err = _error(codes, scale, x)
            near = (qcodes @ codes.astype(np.float32).T).astype(np.float64) * queries[3][:, None] * scale[None, :]
            # |<q,c> - <q',c'>| <= |q'||c-c'| + |q-q'||c'| + |q-q'||c-c'|
            slack = qnorm[:, None] * err + qerr[:, None] * (norm + err)
            slack = slack * (1 + 1e-9) + 1e-12 * np.abs(near)
            for i, q in enumerate(queries[0]):
                heap = heaps[i]
                low, high = near[i] - slack[i], near[i] + slack[i]
                if not np.isfinite(high).all():  # products beyond double precision bound nothing
                    low, high = np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)
                own = ids == q
                if len(heap) == k:
                    bar = heap[0][0]
                else:
                    bar = _bar(np.where(own, -np.inf, low), firsts, k)
                keep = np.flatnonzero((high >= bar) & ~own)
                if not len(keep):
                    continue
                for s, c in zip(exact_products(queries[1][i], x[keep]).tolist(), ids[keep].tolist()):
                    entry = (s, -c)
                    if len(heap) < k:
                        if entry not in heap:
                            heapq.heappush(heap, entry)
                    elif entry > heap[0] and entry not in heap:
                        heapq.heapreplace(heap, entry)
    if heaps is not None and any(heaps):
        yield result()


def nearest(vectors: DataFrame, queries: Column, config: NeighbourConfig = NeighbourConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product for each row that meets ``queries``."""
    rows = vectors.select("vec_id", F.col("embedding")).filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    candidates = shared_table(_packed(rows, config.block)).withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(config.lanes)).cast("int"))
    asked = shared_table(_packed(rows.filter(queries).coalesce(8), config.query_block))
    blocks = asked.select("dim", F.col("block").alias("qblock")).distinct()
    if blocks.limit(FEW_BLOCKS + 1).count() <= FEW_BLOCKS:  # two numbers for each block of queries
        blocks = F.broadcast(blocks)
    heads = asked.select("dim", F.col("block").alias("qblock"), F.explode(F.sequence(F.lit(0), F.lit(config.lanes - 1))).alias("lane"), F.lit(0).alias("side"), F.col("blob"))
    # every candidate block meets every query block of its length: a stated query set against all rows, block by block
    tails = candidates.join(blocks, "dim").select("dim", "qblock", "lane", F.lit(1).alias("side"), "blob")
    cells = heads.unionByName(tails).repartition("dim", "qblock", "lane").sortWithinPartitions("dim", "qblock", "lane", "side")
    k = config.k
    found = cells.mapInPandas(lambda batches: _tiles(batches, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("m"))
    ranked = best.select("query_id", F.posexplode(F.slice("m", 1, k)).alias("p", "x"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
