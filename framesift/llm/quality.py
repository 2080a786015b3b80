"""Quality rules by distribution divergence, as DataFrame expressions only.

Each document gets two histograms: characters by class, and words by the common words of the languages that have a word
list, with one bin for all other words. References are the same histograms summed over the documents of a language in
two rounds: first the median share of each class over documents, by a histogram in thousandths, which junk in less than
half of them moves little; then sums over those that pass the base rules and whose characters lie within ``trim`` of the
first round's, so that junk does not shape what it is held against (a language without such documents keeps all). A
document is rejected when the Jensen-Shannon distance to its language's reference is too large, for either histogram.
Short texts stray from any reference by chance, about with one over the root of their length; so the bound falls with
the length, and below a least length, in the document's own characters or words, a histogram is not looked at.

Cases: null text counts as empty (no words, so the length rule rejects it); an unknown or null language is held
against every reference and the nearest counts; a language without documents has no reference and rejects nothing;
repeated rows each count and each come back; an empty table gives an empty result; other columns of the input, whatever
their names, are not touched or needed; a text of any length is read once and costs n log n: the statistics, a few dozen
numbers a document, go to a shared table from which references and verdicts are made. Three-word windows are compared by
64-bit hashes: two different windows of one text of n words agree with a chance below n * n / 2 ** 65.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, let, shared_table

#: Frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will no more if out so said what up its about into than them can only other".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux ses cette elle mais on comme nous leur y sans été était fait être deux même ont tout si ils bien peut ces".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "ascii_other", "beyond_ascii")


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Below so many characters (words of letters) the distance of that histogram is not looked at.
    min_chars: int = 200
    min_tokens: int = 20
    #: A document is far beyond distance + slack / sqrt(characters), or distance + slack / sqrt(words of letters).
    max_class_distance: float = 0.14
    class_slack: float = 1.0
    max_word_distance: float = 0.18
    word_slack: float = 1.7
    #: Documents up to this class distance from the first round's reference make the second round's.
    trim: float = 0.15


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that stand twice or more in the text.

    Windows are compared by a 64-bit hash. Sorted (hash, place) pairs put equal windows side by side, so the work is
    n log n for any text.
    """
    hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, covered))

    return let(hashes, counted)


def _run_lengths(sorted_words: Column) -> Column:
    def of(c: Column) -> Column:
        starts = F.filter(F.transform(c, lambda x, i: i), lambda i: F.coalesce(F.get(c, i) != F.get(c, i - 1), F.lit(True)))
        return let(starts, lambda s: F.transform(s, lambda at, i: F.struct(F.get(c, at).alias("word"), (F.coalesce(F.get(s, i + 1), F.size(c)) - at).cast("long").alias("n"))))

    return let(sorted_words, of)


def document_stats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, lang, counts of the base rules, characters by class, words of letters (``n_tokens``), and the
    common words among them with their counts.

    ``keep`` names columns that are carried along as the struct ``_keep``.
    """
    held = [F.struct(*(F.col(c) for c in keep)).alias("_keep")] if keep else []
    vocabulary = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", text.alias("_t"), *held)
    kept = ["_keep"] if keep else []
    rows = base.select(
        "doc_id", "lang", *kept,
        F.length("_t").cast("long").alias("_len"),
        let(F.split("_t", f"[{WS}]", -1), lambda p: F.struct((F.size(p) - 1).cast("long").alias("spaces"), let(F.filter(p, lambda x: x != ""), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("repeat"))).alias("w"))).alias("_p"),
        let(F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(f"[^{WS}]")), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")).alias("n_dup_lines"),
        F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", "")).cast("long").alias("_no_symbols"),
        F.struct(F.regexp_replace("_t", rf"[a-z{WS}]+", "").alias("s")).alias("_rest"),
        let(
            F.split(F.lower("_t"), r"[\x00-\x60\x7B-\x7F]+", -1),
            lambda ts: F.struct(
                (F.size(ts) - F.when(F.get(ts, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(ts) > 1) & (F.get(ts, F.size(ts) - 1) == ""), 1).otherwise(0)).cast("long").alias("n"),
                _run_lengths(F.sort_array(F.filter(ts, lambda x: x.isin(vocabulary)))).alias("common"),
            ),
        ).alias("_tokens"),
    )

    def classes(s: Column) -> Column:
        gone = lambda body: F.length(s) - F.length(F.regexp_replace(s, f"[{body}]+", ""))
        known = {"upper": gone("A-Z"), "digit": gone("0-9"), "stop": gone(".,;:!?"), "symbol": gone("#*$%&|<>"), "beyond_ascii": gone(r"^\x00-\x7F")}
        return F.struct(F.length(s).alias("all"), *(v.alias(k) for k, v in known.items()))

    rows = rows.withColumn("_c", let(F.col("_rest.s"), classes))
    of = {
        "lower": F.col("_len") - F.col("_p.spaces") - F.col("_c.all"), "upper": F.col("_c.upper"), "digit": F.col("_c.digit"), "space": F.col("_p.spaces"), "stop": F.col("_c.stop"), "symbol": F.col("_c.symbol"),
        "ascii_other": F.col("_c.all") - F.col("_c.upper") - F.col("_c.digit") - F.col("_c.stop") - F.col("_c.symbol") - F.col("_c.beyond_ascii"), "beyond_ascii": F.col("_c.beyond_ascii"),
    }
    return rows.select(
        "doc_id", "lang", F.col("_p.w.n").alias("n_words"), (F.col("_len") - F.col("_p.spaces")).alias("word_chars"), (F.col("_len") - F.col("_no_symbols")).alias("n_symbols"), "n_dup_lines", F.col("_p.w.repeat").alias("n_repeat_words"),
        F.array(*(of[k].cast("long") for k in CLASSES)).alias("classes"), F.col("_tokens.n").alias("n_tokens"), F.col("_tokens.common").alias("common"), *kept,
    )


def _base_failed(config: QualityConfig) -> Column:
    return (F.col("n_words") < config.min_words) | (100 * F.col("n_repeat_words") > config.max_repeat_percent * F.col("n_words"))


def _class_shares(known: DataFrame, core: Column) -> DataFrame:
    """Per language the shares of the classes over the documents that ``core`` marks; over all, where it marks none."""
    sums = known.withColumn("_core", core).groupBy("lang").agg(
        F.max("_core").alias("_some"), *(F.sum(F.when(F.col("_core"), F.col("classes")[i])).alias(f"core_{c}") for i, c in enumerate(CLASSES)), *(F.sum(F.col("classes")[i]).alias(f"all_{c}") for i, c in enumerate(CLASSES))
    )
    sums = sums.select("lang", *(F.when(F.col("_some"), F.col(f"core_{c}")).otherwise(F.col(f"all_{c}")).alias(c) for c in CLASSES))
    total = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    return sums.select("lang", F.when(total > 0, F.array(*(F.col(c) / total for c in CLASSES))).alias("class_shares"))


def _median_shares(known: DataFrame, config: QualityConfig) -> DataFrame:
    """Per language the median share of each class over documents of ``min_chars``, in thousandths, summing to one.

    A histogram of at most a thousand and one buckets for each language and class, summed on the map side.
    """
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    long_enough = known.withColumn("_all", total).filter(F.col("_all") >= config.min_chars)
    counted = long_enough.select("lang", F.posexplode(F.transform("classes", lambda n: F.floor(1000 * n / F.col("_all")))).alias("c", "b")).groupBy("lang", "c", "b").agg(F.count("*").alias("n"))
    one = Window.partitionBy("lang", "c")
    counted = counted.withColumns({"_upto": F.sum("n").over(one.orderBy("b")), "_of": F.sum("n").over(one)})
    middle = counted.filter(2 * F.col("_upto") >= F.col("_of")).groupBy("lang", "c").agg(F.min("b").alias("b"))
    shares = middle.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "b"))), lambda x: (x["b"] + 0.5) / 1000).alias("s"))
    return shares.select("lang", F.transform("s", lambda x: x / F.aggregate("s", F.lit(0.0), lambda a, y: a + y)).alias("class_shares"))


def references(stats: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """One row per language that has a word list: class shares, and the shares of its common words as a map.

    The result has at most as many rows as there are word lists, as has the first round's, which comes to the driver.
    """
    known = stats.filter(F.col("lang").isin(list(COMMON_WORDS)))
    first = _median_shares(known, config).collect()
    shares = F.create_map(*(x for r in first for x in (F.lit(r.lang), F.array(*map(F.lit, r.class_shares))))) if first else F.create_map().cast("map<string,array<double>>")
    near = F.coalesce(_class_distance(F.col("classes"), F.try_element_at(shares, F.col("lang"))) <= config.trim, F.lit(False))
    known = known.withColumn("_near", ~_base_failed(config) & near)
    by_class = _class_shares(known, F.col("_near"))
    lists = F.create_map(*(x for lang, ws in COMMON_WORDS.items() for x in (F.lit(lang), F.array(*map(F.lit, ws)))))
    sums = (F.sum(F.when(F.col("_near"), F.col("n"))).alias("core"), F.sum("n").alias("all"))
    tokens = known.select("lang", "_near", F.col("n_tokens").alias("n")).groupBy("lang").agg(F.max("_near").alias("_some"), *sums).select("lang", "_some", F.when(F.col("_some"), F.col("core")).otherwise(F.col("all")).alias("_tokens"))
    counted = known.select("lang", "_near", F.explode("common").alias("c")).select("lang", "_near", "c.word", "c.n").groupBy("lang", "word").agg(*sums)
    counted = counted.filter(F.array_contains(lists[F.col("lang")], F.col("word"))).join(tokens, "lang")
    counted = counted.select("lang", "word", (F.when(F.col("_some"), F.col("core")).otherwise(F.col("all")) / F.col("_tokens")).alias("share")).filter("share > 0")
    by_word = counted.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("word", "share"))).alias("word_shares"))
    return by_class.join(by_word, "lang", "left")


def _part(p: Column, q: Column) -> Column:
    """What one bin adds to twice the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    side = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return side(p) + side(q)


def _class_distance(counts: Column, shares: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    parts = let(total, lambda t: F.aggregate(F.arrays_zip(counts.alias("n"), shares.alias("q")), F.lit(0.0), lambda a, x: a + _part(x["n"] / t, x["q"])))
    return F.when(total > 0, F.sqrt(F.greatest(parts / 2, F.lit(0.0))))


def _word_distance(common: Column, tokens: Column, shares: Column, listed: Column) -> Column:
    """The distance over the listed words and one bin for all others. Bins that the document lacks add their whole share."""
    own = F.filter(common, lambda x: F.map_contains_key(shares, x["word"]))

    def parts(o: Column, t: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q"), F.lit(0).cast("long").alias("n"))
        seen = F.aggregate(o, start, lambda a, x: F.struct((a["d"] + _part(x["n"] / t, shares[x["word"]])).alias("d"), (a["q"] + shares[x["word"]]).alias("q"), (a["n"] + x["n"]).alias("n")))
        return let(seen, lambda s: F.sqrt(F.greatest((s["d"] + listed - s["q"] + _part((t - s["n"]) / t, 1 - listed)) / 2, F.lit(0.0))))

    return F.when(tokens > 0, let(own, lambda o: parts(o, tokens)))


def _shares(of: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in sorted(of.items()) for x in pair)).cast("map<string,double>") if of else F.create_map().cast("map<string,double>")


def quality_verdicts(docs: DataFrame, config: QualityConfig = QualityConfig(), keep: list[str] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, word_distance, nearest language, kept; a row per input row.

    With ``keep``, the named columns come back as the struct ``_keep``: they are written beside the statistics once, so
    that a filter on the verdict needs no join with the documents.
    """
    stats = shared_table(document_stats(docs, keep))
    known = [r for r in references(stats, config).collect() if r.class_shares]  # a row per word list at most, whatever the corpus
    refs = F.array(*(F.struct(F.lit(r.lang).alias("lang"), F.array(*map(F.lit, r.class_shares)).cast("array<double>").alias("class_shares"), _shares(r.word_shares or {}).alias("word_shares"), F.lit(float(sum((r.word_shares or {}).values()))).alias("listed")) for r in known))
    empty = "array<struct<lang:string,class_shares:array<double>,word_shares:map<string,double>,listed:double>>"
    rows = stats.withColumn("refs", refs if known else F.array().cast(empty))

    def held(r: Column) -> Column:
        d = _word_distance(F.col("common"), F.col("n_tokens"), r["word_shares"], r["listed"])
        return F.struct(F.coalesce(_class_distance(F.col("classes"), r["class_shares"]), F.lit(0.0)).alias("class_distance"), F.coalesce(d, F.lit(0.0)).alias("word_distance"), r["lang"].alias("language"))

    own = F.filter("refs", lambda r: r["lang"] == F.col("lang"))
    rows = rows.withColumn("_own", own)
    rows = rows.withColumn("_d", F.array_min(F.transform(F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.col("refs")), held)))
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    far = (chars >= config.min_chars) & (F.col("_d.class_distance") > config.max_class_distance + config.class_slack / F.sqrt(chars))
    far = far | ((F.col("n_tokens") >= config.min_tokens) & (F.col("_d.word_distance") > config.max_word_distance + config.word_slack / F.sqrt("n_tokens")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _base_failed(config).alias("base_failed"), (~_base_failed(config) & ~F.coalesce(far, F.lit(False))).alias("kept"),
        F.round("_d.class_distance", 6).alias("class_distance"), F.round("_d.word_distance", 6).alias("word_distance"), F.col("_d.language").alias("language"), *(["_keep"] if keep else []),
    )
