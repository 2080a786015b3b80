"""License scans: an exact set-similarity join of text blocks with license templates, as DataFrame expressions only.

Blocks are all windows of consecutive words, over line ends too, that are 1 / ``threshold`` times as long as the template;
templates and blocks are sets of words. A block matches a template when it holds at least ``threshold`` of the template's
words. The bound on a block's length keeps words that stand far apart from making a notice by chance.

Words of the templates are ordered by how many documents hold them (counted over all documents), rarest first. A block
that can match holds a word of the template's prefix, its first |T| - need + 1 words in that order. So each text is cut
into stretches around words of any prefix (what no window with such a word reaches is left out), and stretches are joined
with the templates on these words: one equi-join with the inverted prefixes, whose size is that of the template list, so
it is broadcast, whatever the number of templates. Filters on joined rows, in order: position (the joined word is the
template's first in the stretch, so a pair comes once, and leaves enough words behind it), length (enough words, and
enough template words, in the stretch). What survives is verified window by window; nothing that meets the threshold is
missed. Texts are not shuffled: stretches and counts are written once, and only rows with stretches take part in the join.

Beside the join, the places of four fixed phrases are reported. Cases: null text counts as empty (no words, no labels,
score 0); an empty table gives an empty result; texts and lines of any length cost about their words times the longest
template; repeated rows come back alike; extra columns, whatever their names, are not used.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, shared_table

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Openings of public license notices, and their labels.
TEMPLATES = (
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without permission"),
)
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LicenseConfig:
    threshold: float = 0.8
    templates: tuple[tuple[str, str], ...] = TEMPLATES


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), f"[{BETWEEN}]+", -1), "")


def word_ranks(docs: DataFrame, config: LicenseConfig = LicenseConfig()) -> dict[str, int]:
    """Rank of every template word, rarest first, by the number of documents that hold it; ties by the word."""
    vocabulary = sorted({w for _, t in config.templates for w in t.split()})
    held = docs.select(F.array_intersect(F.array(*map(F.lit, vocabulary)), _words(F.col("text"))).alias("w"))
    counts = {r.w: r.n for r in held.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row per template word at most
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


@dataclass(frozen=True)
class Template:
    label: str
    tokens: list[str]
    need: int
    size: int

    @property
    def prefix(self) -> list[str]:
        return self.tokens[: len(self.tokens) - self.need + 1]


def ordered_templates(ranks: dict[str, int], config: LicenseConfig = LicenseConfig()) -> list[Template]:
    """Templates with their words rarest first, how many of them a block needs, and how many words a block has."""
    out = []
    for label, text in config.templates:
        t = sorted(set(text.split()), key=ranks.get)
        out.append(Template(label, t, math.ceil(config.threshold * len(t) - 1e-9), math.ceil(len(text.split()) / config.threshold - 1e-9)))
    return out


def _phrase_pattern(phrase: str) -> str:
    return rf"(?i)(?<![^{BETWEEN}])" + rf"[{BETWEEN}]+".join(map(re.escape, phrase.split())) + rf"(?![^{BETWEEN}])"


def _phrase_places(w: Column, phrase: str) -> Column:
    """Starts of the phrase among the words."""
    parts = phrase.split()

    def stands(x: Column, i: Column) -> Column:
        there = x == parts[0]
        for k, part in enumerate(parts[1:], 1):
            there = there & F.coalesce(F.get(w, i + k) == part, F.lit(False))
        return there

    return F.filter(F.transform(w, lambda x, i: F.when(stands(x, i), i)), lambda i: i.isNotNull())


def _stretches(w: Column, prefixes: list[str], reach: int) -> Column:
    """(at, words) of the stretches that windows of up to ``reach`` words with a word of a prefix cover; they don't overlap."""
    anchors = F.filter(F.transform(w, lambda x, i: F.when(x.isin(prefixes), i)), lambda i: i.isNotNull())

    def cut(a: Column) -> Column:
        first = F.filter(F.transform(a, lambda i, k: F.when((k == 0) | (i - F.get(a, k - 1) >= 2 * reach), k)), lambda k: k.isNotNull())

        def one(f: Column, k: Column, j: Column) -> Column:
            low = F.greatest(F.get(a, k) - (reach - 1), F.lit(0))
            last = F.get(a, F.coalesce(F.get(f, j + 1), F.size(a)) - 1)
            return F.struct(low.cast("long").alias("at"), F.slice(w, low + 1, last - low + reach).alias("words"))

        return let(first, lambda f: F.transform(f, lambda k, j: one(f, k, j)))

    return let(anchors, cut)


STRETCHES = "array<struct<at:bigint,words:array<string>>>"


def _template_table(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """The inverted prefixes: a row (word, place, label, tokens, need, size) for each word of each template's prefix."""
    rows = [{"label": t.label, "tokens": t.tokens, "prefix": t.prefix, "need": t.need, "size": t.size} for t in templates]
    schema = "array<struct<label:string,tokens:array<string>,prefix:array<string>,need:int,size:int>>"
    table = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))
    return table.select("label", "tokens", "need", "size", F.posexplode("prefix").alias("place", "word"))


def matches(stretches: DataFrame, templates: list[Template]) -> DataFrame:
    """(_row, at, label, share) from (_row, at, words): for each stretch and template its best window, where that matches."""
    words = sorted({x for t in templates for x in t.prefix})
    keyed = stretches.select("_row", "at", "words", F.explode(F.array_intersect(F.array(*map(F.lit, words)), F.col("words"))).alias("word"))
    pairs = keyed.join(F.broadcast(_template_table(stretches, templates)), "word")
    # position: no earlier word of the template in the stretch, and enough words from this one on
    pairs = pairs.filter((F.size("tokens") - F.col("place") >= F.col("need")) & ~F.arrays_overlap(F.slice("tokens", F.lit(1), F.col("place")), F.col("words")))
    # length
    pairs = pairs.filter((F.size("words") >= F.col("need")) & (F.size(F.array_intersect("tokens", "words")) >= F.col("need")))
    hits = F.filter(F.transform("words", lambda x, i: F.when(F.array_contains(F.col("tokens"), x), i)), lambda i: i.isNotNull())
    held = F.array_max(F.transform(hits, lambda i: F.struct(F.size(F.array_intersect(F.col("tokens"), F.slice(F.col("words"), i + 1, F.col("size")))).alias("n"), (-i).alias("i"))))
    found = pairs.withColumn("_best", held).filter(F.col("_best.n") >= F.col("need"))
    return found.select("_row", (F.col("at") - F.col("_best.i")).alias("at"), "label", (F.col("_best.n") / F.size("tokens")).alias("share"))


def scan_licenses(docs: DataFrame, config: LicenseConfig = LicenseConfig()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and ``blocks``: (at, label, share).

    A block's ``at`` is the place of its first word in the text.
    """
    templates = ordered_templates(word_ranks(docs, config), config)
    prefixes, reach = sorted({x for t in templates for x in t.prefix}), max((t.size for t in templates), default=1)
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    # a cheap test for one word of each phrase comes before the pattern of the phrase
    may_name = lambda t: F.lit(False) if not PHRASES else _any(t.contains(max(p.split(), key=len)) & t.rlike(_phrase_pattern(p)) for p in PHRASES)
    no_places = F.array().cast("array<struct<at:int,label:string>>")

    def places(w: Column) -> Column:
        return F.array_sort(F.concat(*(_labelled(_phrase_places(w, p), PHRASES[p]) for p in PHRASES)))

    def read(w: Column) -> Column:
        near = F.when(F.arrays_overlap(w, F.array(*map(F.lit, prefixes))), _stretches(w, prefixes, reach)) if prefixes else F.lit(None)
        return F.struct(F.size(w).cast("long").alias("n"), near.cast(STRETCHES).alias("near"), F.when(F.col("_named"), places(w)).otherwise(no_places).alias("places"))

    rows = docs.select("doc_id", "text", may_name(lower).alias("_named")).select("doc_id", let(_words(F.col("text")), read).alias("_r"))
    rows = shared_table(rows.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.col("_r.n").alias("n_words"), F.col("_r.places").alias("_places"), F.col("_r.near").alias("_near")))
    stretches = rows.filter("_near is not null").select("_row", F.explode("_near").alias("s")).select("_row", "s.at", "s.words")
    blocks = matches(stretches, templates).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", "label", "share"))).alias("blocks"))
    none = F.array().cast("array<struct<at:bigint,label:string,share:double>>")
    near = rows.filter("_near is not null").drop("_near").join(blocks, "_row", "left").withColumn("blocks", F.coalesce("blocks", none))
    rows = rows.filter("_near is null").drop("_near").withColumn("blocks", none).unionByName(near)
    base = F.array_sort(F.array_distinct(F.transform("_places", lambda p: p["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("blocks", lambda m: m["label"]))))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda m: m["share"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("_places").cast("long").alias("n_base"), F.get("_places", F.lit(0))["at"].cast("long").alias("first_word"), F.get("_places", F.size("_places") - 1)["at"].cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(best).alias("score"), "blocks",
    )


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
