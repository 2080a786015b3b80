"""MinHash near-duplicates by a multi-index Hamming join.

1. Every text gets its set of five-word shingles and a signature of ``symbols`` MinHash values of ``bits`` bits. Texts
   with the same set are one class from here on, represented by the smallest id.
2. Signatures are split into chunks. If two differ in at most ``distance`` symbols, some chunk of theirs differs in at
   most ``errors`` (pigeonhole); so each chunk is keyed with every choice of ``errors`` symbols left out, and two such
   signatures share a key for certain. At a similarity of 0.75 a pair is within the distance but for a chance of 1e-5.
3. Members of a key are not paired with each other. Each class is first held against the smallest member of the key it
   shares most often with one (a star, linear in the rows), on full sets; what links forms components.
4. Only where a key still joins different components, members are compared across components, in blocks of ``block``
   rows. First each class is held against its nearest such member by signature only (linear again: copies of a text that
   are less like each other than like the text meet in it here), and components are formed anew. Then every remaining
   pair across components is tested: by signature distance, by a sketch of ``bins`` bytes whose error is bounded at more
   than four standard deviations, and what survives on full sets. So a large group of near copies costs stars, and no
   link that could join two components goes untested.

Full sets are made again from the texts of those ids alone that take part in a test; ids are sought by a bitmap of
fixed size, so other texts are not shuffled.

A key that very many classes share is combined on the map side, a batch at a time, so its task reads a row a batch; a hot
centre's partners are dealt to tasks by ``star``, a hot key's members by ``block``.

Cases: null or wordless text has an empty set, is linked with nothing and is kept; a null id is linked with nothing;
repeated rows have the same set and come back alike; rows with one id and different texts are nodes of their own, each
with the smallest id it reaches; an empty table gives an empty result; texts of any length are read whole, one at a time
where long; extra columns, whatever their names, are not used.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import shared_table
from .components import components


@dataclass(frozen=True)
class NearDupConfig:
    words: int = 5
    percent: int = 75
    symbols: int = 64
    bits: int = 16
    chunk: int = 4
    errors: int = 1
    block: int = 1024
    bins: int = 512
    #: Bits of the bitmap by which texts are looked up; a fixed size (2 ** 26 bits are 8 MB).
    bitmap: int = 1 << 26
    #: Members of a star that one task holds against its centre.
    star: int = 256

    @property
    def distance(self) -> int:
        """The largest signature distance for which a shared key is certain."""
        return (self.errors + 1) * (self.symbols // self.chunk) - 1


def signed(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (128 bits of the set), sig (the symbols as bytes), sketch."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                sets = list(shingles.shingle_sets([t if isinstance(t, str) else None for t in part["text"]], config.words))
                sigs = shingles.signatures(sets, config.symbols, config.bits)
                ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                sketch = [s.tobytes() for s in shingles.sketches(sets, config.bins)]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").values, "text_hash": part["text_hash"].values, "n_shingles": [len(s) for s in sets], "set_id": ids, "sig": [s.tobytes() for s in sigs], "sketch": sketch})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInPandas(sign, "doc_id long, text_hash long, n_shingles long, set_id binary, sig binary, sketch binary")


def chunk_keys(sigs: np.ndarray, config: NearDupConfig) -> np.ndarray:
    """The keys of every signature: one per chunk and choice of symbols that are left out."""
    out = []
    for c in range(config.symbols // config.chunk):
        part = sigs[:, c * config.chunk : (c + 1) * config.chunk].astype(np.uint64)
        for p, kept in enumerate(itertools.combinations(range(config.chunk), config.chunk - config.errors)):
            key = np.full(len(sigs), c * 1000 + p + 1, np.uint64)
            for k in kept:
                key = shingles._mixed(key * np.uint64(0x9E3779B97F4A7C15) + part[:, k])
            out.append(key.view(np.int64))
    return np.stack(out, axis=1) if out else np.empty((len(sigs), 0), np.int64)


def _matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), -1)


def keyed(reps: DataFrame, config: NearDupConfig) -> DataFrame:
    """(key, number, first, rep): first is the smallest rep of the key in a batch. Where it is not rep itself, the row is
    settled: rep belongs to the key of first, and only first has to be held against other batches."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 10_000):
                part = batch.iloc[at : at + 10_000].sort_values("rep")
                keys = chunk_keys(_matrix(part["sig"]), config)
                number = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(part))
                key, rep = keys.ravel(), np.repeat(part["rep"].to_numpy(), keys.shape[1])
                order = np.argsort(key, kind="stable")
                key, rep, number = key[order], rep[order], number[order]
                new = np.append(True, key[1:] != key[:-1])
                first = rep[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
                yield pd.DataFrame({"key": key, "number": number, "first": first, "rep": rep})

    return reps.select("rep", "sig").mapInPandas(expand, "key long, number int, first long, rep long")


def memberships(keys: DataFrame) -> DataFrame:
    """(key, number, first, rep) for each key with several members; over its rows, first and rep join all of them.

    Settled rows go anywhere; the others meet by key, and their first is the smallest. One pass over sorted rows.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, leader = None, None
        for batch in batches:
            settled = batch["settled"].to_numpy(bool)
            if settled.any():
                yield batch.loc[settled, ["key", "number", "first", "rep"]]
                batch = batch[~settled]
            k, r = batch["key"].to_numpy(), batch["rep"].to_numpy()
            if not len(k):
                continue
            new = np.empty(len(k), bool)
            new[0] = k[0] != key
            new[1:] = k[1:] != k[:-1]
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            pivot = np.where(at < 0, leader if leader is not None else 0, r[np.maximum(at, 0)])
            key, leader = k[-1], pivot[-1]
            keep = ~new & (pivot != r)
            yield pd.DataFrame({"key": k[keep], "number": batch["number"].to_numpy()[keep], "first": pivot[keep], "rep": r[keep]})

    keys = keys.withColumn("settled", F.col("first") != F.col("rep"))
    keys = keys.withColumn("_to", F.when(F.col("settled"), F.xxhash64("key", "rep")).otherwise(F.col("key")))
    return keys.repartition("_to").sortWithinPartitions("settled", "key", "rep").drop("_to").mapInPandas(scan, "key long, number int, first long, rep long")


def _parts(df: DataFrame) -> int:
    """Tasks for work in Python, whose time a shuffle's bytes do not tell: as many as the session has for shuffles."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _in_bitmap(rows: DataFrame, ids: list[str], wanted: DataFrame, config: NearDupConfig) -> DataFrame:
    """``rows`` with the columns _bit and ``_may``: whether the hash of ``ids`` is that of some row of ``wanted``.

    True for all that are wanted, and for few others, by a bitmap over hashes. The bitmap is broadcast; its size is fixed by
    ``bitmap``, whatever the number of rows. Where it fills up, more rows are true and the join that follows does the rest.
    """
    place = F.pmod(F.xxhash64(*ids), F.lit(config.bitmap))
    bits = wanted.select(F.call_function("bitmap_bucket_number", place).alias("_bucket"), F.call_function("bitmap_bit_position", place).alias("_bit"))
    bitmap = bits.groupBy("_bucket").agg(F.call_function("bitmap_construct_agg", F.col("_bit")).alias("_map"))
    at = F.call_function("bitmap_bit_position", place)
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_bucket", F.call_function("bitmap_bucket_number", place)).join(F.broadcast(bitmap), "_bucket", "left")
    return found.withColumn("_may", F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))).drop("_bucket", "_map")


def texts_of(texts: DataFrame, wanted: DataFrame, config: NearDupConfig) -> DataFrame:
    """The texts whose id may be wanted: all that are, and few others; the others are not shuffled."""
    return _in_bitmap(texts, ["doc_id"], wanted, config).filter("_may").select("doc_id", "text")


def verified(pairs: DataFrame, texts: DataFrame, config: NearDupConfig) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold.

    Pairs are dealt by a and a salt; a's text goes once to each, ahead of the texts of its partners, so a task holds one
    set of a at a time, and a hot a is spread over many tasks. Texts are taken only of ids that occur in a pair.
    """
    salted = shared_table(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(1 << 20)).alias("_h")))
    parts = salted.groupBy("a").agg(F.ceil(F.count("*") / config.star).alias("_n"))
    salted = shared_table(salted.join(parts, "a").select("a", "b", (F.col("_h") % F.col("_n")).alias("salt")))
    heads = salted.select("a", "salt").distinct().select(F.col("a").alias("doc_id"), "a", "salt", F.lit(0).alias("side"))
    wanted = heads.unionByName(salted.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("side")))
    rows = wanted.join(texts_of(texts, wanted, config), "doc_id").repartition(_parts(pairs), "a", "salt").sortWithinPartitions("a", "salt", "side", "doc_id")

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, own, last = None, None, None
        for batch in batches:
            out = []
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                sets = shingles.shingle_sets(list(part["text"]), config.words)
                for a, salt, side, doc, s in zip(part["a"], part["salt"], part["side"], part["doc_id"], sets):
                    if side == 0:
                        head, own, last = (a, salt), s, None
                    elif head == (a, salt) and doc != last:
                        last = doc
                        both, union = shingles.jaccard(own, s)
                        if both and 100 * both >= config.percent * union:
                            out.append((a, doc))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.select("a", "salt", "side", "doc_id", "text").mapInPandas(test, "a long, b long")


def _groups(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Whole runs of rows with equal ``columns``, from rows that come sorted by them; one run is held at a time."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[columns].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if rest and (rest[-1][columns].to_numpy()[-1] != k[0]).any():
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = []
        at = 0
        for cut in cuts:
            part = batch.iloc[at:cut]
            if rest:
                part, rest = pd.concat([*rest, part]), []
            if len(part) > 1:
                yield part
            at = cut
        rest.append(batch.iloc[at:])
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def _cells(members: DataFrame, config: NearDupConfig) -> DataFrame:
    """Rows of keys, dealt by (key, x, y): a key with more than ``block`` members is cut into blocks, and each pair of its
    blocks is a group of its own, so no task holds more than two blocks at a time."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / config.block).cast("int").alias("_n"))
    m = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int"))
    m = m.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    m = m.withColumns({"x": F.least("own", "_o"), "y": F.greatest("own", "_o")}).drop("_n", "_o")
    return m.repartition(_parts(members), "key", "x", "y").sortWithinPartitions("key", "x", "y")


class _Cell:
    """The columns of one group as arrays, taken out of the frame once."""

    def __init__(self, g: pd.DataFrame, config: NearDupConfig):
        self.sigs, self.rep, self.n, self.comp = _matrix(g["sig"]), g["rep"].to_numpy(), g["n"].to_numpy(), g["comp"].to_numpy()
        self.own = g["own"].to_numpy() if g["x"].iat[0] != g["y"].iat[0] else None
        self.config = config

    def candidates(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Later rows of another component, and of the other block, whose size and signature allow a link with row i; and
        their distances."""
        rest = slice(i + 1, None)
        n, m = self.n[rest], self.n[i]
        ok = (self.comp[rest] != self.comp[i]) & (100 * np.minimum(n, m) >= self.config.percent * np.maximum(n, m))
        if self.own is not None:
            ok &= self.own[rest] != self.own[i]
        js = np.flatnonzero(ok)
        if len(js):
            js += i + 1
            far = np.count_nonzero(self.sigs[js] != self.sigs[i], axis=1)
            near = far <= self.config.distance
            return js[near], far[near]
        return js, js


def nearest_pairs(members: DataFrame, config: NearDupConfig) -> DataFrame:
    """(a, b): for each rep the member of another component, in any of its keys, with the nearest signature."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, ["key", "x", "y"]):
            cell = _Cell(g, config)
            rep = cell.rep.tolist()
            best: dict[int, tuple[int, int]] = {}
            for i in range(len(g) - 1):
                js, far = cell.candidates(i)
                for j, d in zip(js.tolist(), far.tolist()):
                    for p, q in ((i, j), (j, i)):
                        if p not in best or (d, rep[q]) < best[p]:
                            best[p] = (d, rep[q])
            if best:
                yield pd.DataFrame([(rep[p], d, q) for p, (d, q) in best.items()], columns=["rep", "far", "other"])

    found = _cells(members.select("key", "rep", "comp", "n", "sig"), config).mapInPandas(compare, "rep long, far long, other long")
    near = found.groupBy("rep").agg(F.min(F.struct("far", "other")).alias("m"))
    return near.select(F.least("rep", "m.other").alias("a"), F.greatest("rep", "m.other").alias("b")).distinct()


def close_pairs(members: DataFrame, config: NearDupConfig) -> DataFrame:
    """(a, b): every pair of different components within a key that signature and sketch allow.

    A pair that shares several keys is given by the first of them only.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ways = list(itertools.combinations(range(config.chunk), config.chunk - config.errors))
        for g in _groups(batches, ["key", "x", "y"]):
            cell, number = _Cell(g, config), int(g["number"].iat[0])
            s, rep, n = cell.sigs, cell.rep, cell.n
            k = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(g), -1)
            out = []
            for i in range(len(g) - 1):
                js, _ = cell.candidates(i)
                if not len(js):
                    continue
                same = (s[js] == s[i]).reshape(len(js), -1, config.chunk)
                earlier = np.zeros(len(js), bool)
                for c in range(number // len(ways) + 1):
                    for w, kept in enumerate(ways):
                        if c * len(ways) + w < number:
                            earlier |= same[:, c, list(kept)].all(axis=1)
                js = js[~earlier]
                if not len(js):
                    continue
                there = (k[js] > 0) | (k[i] > 0)
                e = there.sum(axis=1)
                equal = ((k[js] == k[i]) & there).sum(axis=1)
                t = config.percent / 100
                union = np.maximum((n[js] + n[i]) / (1 + t), 1)
                p = t + (1 - t) / 255
                bar = e * p - 4.5 * np.sqrt(e * p * (1 - p) * np.maximum(1 - e / union, 0.02)) - 2
                js = js[equal >= bar]
                out += [(min(int(rep[i]), int(rep[j])), max(int(rep[i]), int(rep[j]))) for j in js]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return _cells(members, config).mapInPandas(compare, "a long, b long").distinct()


def _apart(met: DataFrame, reps: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, number, rep, comp) of the keys that still join components, and the component of each rep."""
    comp_of = shared_table(reps.select("rep").join(comp, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("comp")))
    both = met.join(comp_of, "rep").join(comp_of.select(F.col("rep").alias("first"), F.col("comp").alias("first_comp")), "first")
    apart = shared_table(both.filter("comp <> first_comp").select("key").distinct())
    rows = met.join(apart, "key", "left_semi")
    rows = rows.select("key", "number", "rep").unionByName(rows.select("key", "number", F.col("first").alias("rep"))).distinct()
    return shared_table(rows.join(comp_of, "rep")), comp_of


def near_duplicates(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return _resolved(docs, config).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component: that of the smallest id, of its texts the first by
    hash. Texts without words and rows without an id stay, but of rows that repeat an id and a text (by a 64-bit hash) one.

    Only rows that go or repeat, and few others (see ``_in_bitmap``), are shuffled with their texts.
    """
    rows = _resolved(docs, config).filter("doc_id is not null").groupBy("doc_id", "text_hash")
    rows = shared_table(rows.agg(F.count("*").alias("n"), F.max(F.col("n_shingles") > 0).alias("linked"), F.min("component").alias("component"), F.min("component_id").alias("component_id")))
    # an id that is not its component's smallest goes; only texts under the smallest id are compared
    heads = rows.filter("linked and doc_id = component_id").select("doc_id", "text_hash", "component")
    least = heads.groupBy("doc_id", "component").agg(F.min("text_hash").alias("least"), F.count("*").alias("m")).filter("m > 1")
    behind = heads.join(least, ["doc_id", "component"]).filter("text_hash <> least").select("doc_id", "text_hash", F.lit(True).alias("behind"))
    goes = F.col("linked") & ((F.col("doc_id") != F.col("component_id")) | F.col("behind").isNotNull())
    special = rows.join(behind, ["doc_id", "text_hash"], "left").withColumn("_goes", goes).filter("_goes or n > 1")
    special = shared_table(special.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_goes"))
    held = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    held = _in_bitmap(held, ["_id", "_hash"], special, config)
    some = held.filter("_may and _id is not null").join(special, ["_id", "_hash"], "left")
    some = some.filter("_goes is null").select("_row").unionByName(some.filter("not _goes").dropDuplicates(["_id", "_hash"]).select("_row"))
    return held.filter("not _may or _id is null").select("_row").unionByName(some).select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def _resolved(docs: DataFrame, config: NearDupConfig) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (its smallest node) and component_id (its smallest id) of every row."""
    docs = docs.select("doc_id", "text")
    rows = shared_table(signed(docs, config))
    sets = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi"))
    several = shared_table(sets.filter("lo <> hi").select("doc_id"))
    if several.isEmpty():  # ids are nodes
        return _components_of(docs, rows.withColumn("node", F.col("doc_id")), config).withColumn("component_id", F.col("component"))
    # an id with several texts: each is a node, named by a hash of both
    several = several.withColumn("_several", F.lit(True))
    node = lambda h: F.when(F.col("_several"), F.xxhash64("doc_id", h)).otherwise(F.col("doc_id"))
    texts = docs.join(several, "doc_id", "left").select(node(F.xxhash64("text")).alias("doc_id"), "text")
    found = shared_table(_components_of(texts, rows.join(several, "doc_id", "left").withColumn("node", node(F.col("text_hash"))).drop("_several"), config))
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component", "left")


def _components_of(texts: DataFrame, rows: DataFrame, config: NearDupConfig) -> DataFrame:
    """doc_id, text_hash, n_shingles and component (the smallest node reached) of every row; ``texts`` is by node."""
    reps = rows.filter("n_shingles > 0 and node is not null").groupBy("set_id").agg(F.min("node").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    reps = shared_table(reps)
    size = reps.select(F.col("rep").alias("r"), "n")
    met = shared_table(memberships(keyed(reps, config)))
    # a star: each class with the member that leads most of its keys
    shared = met.groupBy("rep", "first").agg(F.count("*").alias("c")).groupBy("rep").agg(F.max(F.struct(F.col("c"), (-F.col("first")).alias("f"))).alias("m"))
    tested = shared_table(_plausible(shared.select((-F.col("m.f")).alias("a"), F.col("rep").alias("b")), size, config))
    links = shared_table(verified(tested, texts, config))
    comp = components(links)
    # stars around nearest members, then whatever is left
    for choose, columns in ((nearest_pairs, ["n", "sig"]), (close_pairs, ["n", "sig", "sketch"])):
        members, _ = _apart(met, reps, comp)
        pairs = choose(members.join(reps.select("rep", *columns), "rep"), config)
        pairs = shared_table(pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        tested = tested.unionByName(pairs)
        links = links.unionByName(shared_table(verified(pairs, texts, config)))
        comp = components(links)
    classes = reps.select("set_id", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("component", "rep").alias("_c"))
    out = rows.select("doc_id", "text_hash", "n_shingles", "node", "set_id").join(classes, "set_id", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("node").isNotNull(), F.coalesce("_c", "node")).otherwise(F.col("node"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component"))


def _plausible(pairs: DataFrame, size: DataFrame, config: NearDupConfig) -> DataFrame:
    """Drops pairs whose set sizes rule the similarity out."""
    a, b = size.select(F.col("r").alias("a"), F.col("n").alias("na")), size.select(F.col("r").alias("b"), F.col("n").alias("nb"))
    return pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= config.percent * F.greatest("na", "nb")).select("a", "b")
