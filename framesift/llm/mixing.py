"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 64-bit hash. A source that is to give f of its words (beyond whole copies) gives the documents
whose hash lies below a threshold. The threshold is found without sorting: words are summed by source and by the top
bits of the hash, the bucket in which the running sum crosses the budget is the boundary bucket, and only that bucket is
summed again by the next bits, until it holds one hash value. Thresholds are nested: a larger budget takes a superset.

Cases: null text has size 0; null source is a source of its own, ordered last; repeated rows share a hash and are taken
together; a source without words has target 0 and gives nothing; an empty table gives an empty result. Results depend on
the rows only, never on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, shared_table


@dataclass(frozen=True)
class MixConfig:
    #: Weights of the sources in code point order, repeating.
    weights: tuple[int, ...] = (1, 2, 3)
    max_repeats: int = 3
    #: Bits of the hash that each level of the histogram resolves.
    bits: int = 12
    seed: int = 17


def row_hash(config: MixConfig = MixConfig()) -> Column:
    return F.xxhash64(F.lit(config.seed), F.col("doc_id"), F.col("text"))


def sized(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """docs with ``_size`` (words) and ``_hash`` (64 bits of id and text)."""
    return docs.withColumns({"_size": n_words(F.col("text")), "_hash": row_hash(config)})


def targets(sources: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """From (source, source_size) to (source, source_size, target).

    The targets solve sum(min(repeats * size, level * weight)) = all sizes for the level: what repeated resharing of
    the excess ends in. Sources are ordered by their ratio of cap to weight; those up to some place stop at their cap.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, config.weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(config.weights))) + 1).cast("int")).cast("double")
    s = sources.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(config.max_repeats))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumns({"_all": F.sum("source_size").over(whole).cast("double"), "_weights": F.sum("_w").over(whole), "_cb": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_wb": F.coalesce(F.sum("_w").over(before), F.lit(0.0))})
    s = s.withColumn("_level", (F.col("_all") - F.col("_cb")) / (F.col("_weights") - F.col("_wb")))
    # up to the first source, in this order, whose cap lies above its own level, all stop; that level is the common one
    first = F.min(F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))).over(whole)["level"]
    s = s.withColumn("_at", first)
    return s.select("source", "source_size", F.when(F.col("_at").isNull() | (F.col("_cap") <= F.col("_at") * F.col("_w")), F.col("_cap")).otherwise(F.col("_at") * F.col("_w")).alias("target"))


def _bits(level: int, bits: int) -> Column:
    """The bits of the hash, taken as unsigned, that this level resolves."""
    return F.expr(f"shiftrightunsigned(shiftleft(_hash, {level * bits}), {64 - min(bits, 64 - level * bits)})")


def thresholds(rows: DataFrame, budgets: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """(source, _below): a document is inside the budget when its hash, as unsigned, is at most _below; null: none is.

    ``rows`` has source, _size, _hash; ``budgets`` has source, _budget (words). At each level only the boundary
    buckets' rows are read on, so a level costs a map-side sum over few rows.
    """
    found = budgets.select(F.col("source").alias("_s"), F.col("_budget").alias("_left"), F.lit(0).cast("long").alias("_prefix"))
    levels = -(-64 // config.bits)
    for level in range(levels):
        done = level * config.bits
        here = rows.select("source", "_size", "_hash") if level == 0 else rows.join(
            found, F.col("source").eqNullSafe(F.col("_s")) & (F.expr(f"shiftrightunsigned(_hash, {64 - done})") == F.col("_prefix")), "left_semi"
        ).select("source", "_size", "_hash")
        sums = here.withColumn("_b", _bits(level, config.bits)).groupBy("source", "_b").agg(F.sum("_size").alias("_n"), F.min("_hash").alias("_lo"), F.max("_hash").alias("_hi"))
        sums = sums.withColumn("_upto", F.sum("_n").over(Window.partitionBy("source").orderBy("_b")))
        crossing = sums.join(found.select("_s", "_left", "_prefix"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_upto") > F.col("_left")))
        first = crossing.groupBy("_s").agg(F.min(F.struct("_b", "_upto", "_n", "_left", "_prefix", "_lo", "_hi")).alias("f"))
        width = min(config.bits, 64 - done)
        found = shared_table(first.select("_s", (F.col("f._left") - F.col("f._upto") + F.col("f._n")).alias("_left"), F.expr(f"shiftleft(f._prefix, {width}) + f._b").alias("_prefix"), F.col("f._lo").alias("_lo"), F.col("f._hi").alias("_hi"), F.col("f._n").alias("_n")), partitions=1)
        if level + 1 == levels or found.filter("_lo <> _hi").isEmpty():
            return found.select("_s", "_left", "_n", F.col("_lo"), F.lit(done + width).alias("_bits"), "_prefix")
    raise AssertionError("unreachable")


def mix(docs: DataFrame, config: MixConfig = MixConfig(), keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, _hash, size, source_size, target, taken, copies of every document, sized once into a shared table.

    With ``keep``, the named columns are carried along as the struct ``_keep``.
    """
    held = [F.struct(*(F.col(c) for c in keep)).alias("_keep")] if keep else []
    rows = shared_table(docs.select("doc_id", "source", n_words(F.col("text")).alias("_size"), row_hash(config).alias("_hash"), *held))
    return mix_sized(rows, config, bool(keep))


#: Up to so many sources, their targets are broadcast (a few numbers each); beyond it, documents are joined with them.
FEW_SOURCES = 20_000


def mix_sized(rows: DataFrame, config: MixConfig = MixConfig(), keep: bool = False) -> DataFrame:
    sources = rows.groupBy("source").agg(F.sum("_size").alias("source_size"))
    goals = shared_table(targets(sources, config), partitions=1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = goals.withColumn("_whole", whole.cast("long")).withColumn("_budget", F.col("target") - F.col("_whole") * F.col("source_size"))
    cuts = thresholds(rows, goals.filter("source_size > 0 and _budget < source_size"), config)
    # the boundary value itself is taken when that comes nearer to the budget
    cuts = cuts.select("_s", F.col("_lo").alias("_cut"), (F.col("_n") <= 2 * F.col("_left")).alias("_with"))
    goals = goals.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_src")
    few = goals.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    out = rows.join(F.broadcast(goals) if few else goals, F.col("source").eqNullSafe(F.col("_src")))
    flip = lambda c: c.bitwiseXOR(F.lit(-(2**63)).cast("long"))  # noqa: E731  unsigned order
    below = (flip(F.col("_hash")) < flip(F.col("_cut"))) | ((F.col("_hash") == F.col("_cut")) & F.col("_with"))
    copies = F.col("_whole") + F.when(F.coalesce(below, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    return out.select("doc_id", "source", "_hash", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * copies).alias("taken"), copies.alias("copies"), *(["_keep"] if keep else []))
