"""Search over postings: clauses of (slots, values), strict or ranked; ties are kept everywhere.

Literal clauses become one pushed-down filter and one grouped bit mask: a single shuffle of matching postings, combined
map-side. Clauses made from sample frames become joins; candidates' hot values are dealt with by skewed joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index
from .masks import Clause, all_hold, count_held


def find_frames(index: Index, *clauses: Clause) -> DataFrame:
    """FIND-FRAMES: or inside a clause, and across clauses; a clause without postings empties the result."""
    return all_hold(index.postings, list(clauses))


def scores(index: Index, *clauses: Clause, candidates: DataFrame | None = None) -> DataFrame:
    """GET-SCORES: (oid, score), the number of clauses that hold the frame."""
    out = count_held(index.postings, list(clauses))
    return out if candidates is None else out.join(candidates.select("oid").distinct(), "oid", "left_semi")


def best(scored: DataFrame) -> DataFrame:
    """GET-BEST: every frame with the highest score."""
    top = scored.agg(F.max("score").alias("_top"))  # one row
    return scored.join(F.broadcast(top), scored["score"] == top["_top"]).drop("_top")


def sample_clauses(index: Index, samples: DataFrame, slots: list[str] | None = None) -> DataFrame:
    """One clause per (sample, slot): rows (sample, slot, value)."""
    rows = index.postings if slots is None else index.postings.filter(F.col("slot").isin(*slots))
    return rows.join(samples.select("oid").distinct(), "oid", "left_semi").select(F.col("oid").alias("sample"), "slot", "value")


def scores_from_samples(index: Index, samples: DataFrame, slots: list[str] | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """GET-SCORES-FROM-SAMPLES: (oid, score), clauses being distinct (sample, slot)."""
    clauses = sample_clauses(index, samples, slots)
    rows = index.postings if candidates is None else index.postings.join(candidates.select("oid").distinct(), "oid", "left_semi")
    met = rows.join(clauses, ["slot", "value"]).select("oid", "sample", "slot").distinct()
    return met.groupBy("oid").agg(F.count("*").alias("score"))


def find_similar(index: Index, samples: DataFrame, slots: list[str] | None = None) -> DataFrame:
    """FIND-SIMILAR: frames that share a value on every (sample, slot) clause."""
    n = sample_clauses(index, samples, slots).select("sample", "slot").distinct().agg(F.count("*").alias("_n"))  # one row
    scored = scores_from_samples(index, samples, slots)
    return scored.join(F.broadcast(n), scored["score"] == n["_n"]).select("oid")


def _samples_last(scored: DataFrame, samples: DataFrame) -> DataFrame:
    mark = samples.select("oid").distinct().withColumn("_sample", F.lit(True))
    return scored.join(mark, "oid", "left").select("oid", F.when(F.col("_sample"), F.lit(0).cast("long")).otherwise(F.col("score")).alias("score"))


def best_from_samples(index: Index, samples: DataFrame, slots: list[str] | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """GET-BEST-FROM-SAMPLES: the samples' own score counts as 0."""
    return best(_samples_last(scores_from_samples(index, samples, slots, candidates), samples))


def similar_scored(index: Index, samples: DataFrame, require: list[str] | None = None) -> DataFrame:
    """GET-SIMILAR-SCORED: candidates match every clause over the required slots, are scored over all slots, samples count
    0, ties are kept; if nothing else is left the samples come back."""
    candidates = None if require is None else find_similar(index, samples, require)
    return best_from_samples(index, samples, None, candidates)


def search_all(indices: list[Index], *clauses: Clause) -> DataFrame:
    """$?, ??, ?INDEX: FIND-FRAMES over several registered indices, united."""
    return find_frames(Index.compound(*indices), *clauses)


def similar(index: Index, samples: DataFrame, require: list[str] | None = None) -> DataFrame:
    return similar_scored(index, samples, require).select("oid")
