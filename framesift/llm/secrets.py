"""Secret scans with multipart credential linking, as DataFrame expressions only.

Strong findings (assigned values, access identifiers, long hexadecimal runs) are reported where they stand. Weak
findings are parts that mean little alone: endpoints (URLs, hosts with ports) and mixed-case tokens that look like key
material. They are reported only when complementary parts co-occur: an interval join inside a document links an access
identifier or an assigned value with weak tokens, and endpoints with those, whose distance is at most ``scope`` code
points. The join is an equi-join on (row, bucket of ``scope`` code points) with each part dealt to every bucket it
touches or reaches, whatever its length, so a long document's findings spread over many keys.

Places of matches come from splitting: the lengths of the pieces between matches and of the matches add up to the
starts, in code points, by running sums over blocks of blocks, so a text with very many matches costs little more than
its length. Cases: null text counts as empty; a row without findings has zero counts and empty spans; an empty table
gives an empty result; repeated rows are scanned alike and each come back; extra columns, whatever their names, are not
used, and ``redact`` hands them through. Rows are told apart in the join by a 64-bit hash of id and text: two of n rows
share it with a chance below n * n / 2 ** 65.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, shared_table

#: Kinds in report order, with pattern, group that is measured, and least length.
BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "endpoint": (r"(?i:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x00-\x20\"'<>]+", 0, 10),
    "key": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])[A-Za-z0-9+/]{32,}={0,2}", 0, 32),
}
KINDS = (*BASE, *WEAK)
#: What a document must contain, as a cheap test before a pattern is split by; None: the pattern itself is tested.
HINTS = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "hex": None, "endpoint": "://", "key": None}


@dataclass(frozen=True)
class SecretConfig:
    #: Code points between linked parts.
    scope: int = 200


SPANS = "array<struct<start:bigint,end:bigint>>"


def match_spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """(start, end) of the leftmost non-overlapping matches, kept if the group has ``least`` code points."""

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = let(F.split(text, pattern, -1), lambda p: let(whole, lambda f: _places(p, f)))
    if not group:
        return F.filter(spans, lambda s: s["end"] - s["start"] >= least)
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return let(inner, lambda g: F.filter(spans, lambda s, i: F.length(F.get(g, i)) >= least))


BLOCK = 64


def _running(values: Column, combine, zero: Column, levels: int = 3) -> Column:
    """For each place of an array, ``combine`` over all values before it.

    An array is cut into blocks of ``BLOCK``; each block is combined, and the running values of these are found the same
    way. For n values that are about 2 * BLOCK * n steps, and (n / BLOCK ** levels) ** 2 more.
    """

    def over(part: Column) -> Column:
        return F.aggregate(part, zero, combine)

    if levels == 0:
        return F.transform(values, lambda x, i: over(F.slice(values, F.lit(1), i)))

    def blocked(v: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / BLOCK), F.lit(0)).cast("int")), lambda b: over(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))

        def placed(before: Column) -> Column:
            def at(i: Column) -> Column:
                b = F.floor(i / BLOCK).cast("int")
                return combine(F.get(before, b), over(F.slice(v, b * BLOCK + 1, i % BLOCK)))

            return F.transform(v, lambda x, i: at(i))

        return let(let(whole, lambda w: _running(w, combine, zero, levels - 1)), placed)

    few = F.transform(values, lambda x, i: over(F.slice(values, F.lit(1), i)))
    return F.when(F.size(values) <= BLOCK, few).otherwise(let(values, blocked))


def _places(pieces: Column, found: Column) -> Column:
    """(start, end) of the matches; a step is (length of the piece before, length of the match)."""
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, f: F.struct(F.length(p).cast("long").alias("gap"), F.length(f).cast("long").alias("len")))

    def summed(st: Column) -> Column:
        before = _running(F.transform(st, lambda x: x["gap"] + x["len"]), lambda a, x: a + x, F.lit(0).cast("long"))
        return F.zip_with(before, st, lambda b, x: F.struct((b + x["gap"]).alias("start"), (b + x["gap"] + x["len"]).alias("end")))

    return let(steps, summed)


def _found(text: Column, kind: str) -> Column:
    pattern, group, least = (BASE | WEAK)[kind]
    hint = HINTS[kind]
    there = text.contains(hint) if hint and hint.isascii() and hint.replace(":", "").replace("/", "").isalnum() and "(" not in hint or hint == "://" else text.rlike(hint or pattern)
    return F.when(there, match_spans(text, pattern, group, least)).otherwise(F.array().cast(SPANS))


def scan_rows(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, ``_row`` (a hash of id and text) and an array of (start, end) per kind; the text is read once.

    ``keep`` names columns that are carried along as the struct ``_keep``.
    """
    held = [F.struct(*(F.col(c) for c in keep)).alias("_keep")] if keep else []
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_row"), text.alias("_t"), *held)
    return base.select("doc_id", "_row", *(["_keep"] if keep else []), *(_found(F.col("_t"), k).alias(k) for k in KINDS))


def _kinded(kind: str, last: str = "kind"):
    number = F.lit(KINDS.index(kind)).alias("kind")
    return lambda s: F.struct(s["start"], s["end"], number) if last == "kind" else F.struct(s["start"], number, s["end"])


def _both_sides() -> Column:
    return (F.size("endpoint") + F.size("key") > 0) & (F.size("assign") + F.size("access") + F.size("hex") > 0)


def linked(rows: DataFrame, config: SecretConfig = SecretConfig()) -> DataFrame:
    """Weak findings with a complementary part in scope: _row and ``_linked``, the sorted (start, end, kind number).

    Complements: a key needs an access identifier or an assigned value; an endpoint needs an access identifier, an
    assigned value or a long hexadecimal run. Only rows with both sides take part.
    """
    strong = F.concat(*(F.transform(k, _kinded(k)) for k in BASE))
    weak = F.concat(*(F.transform(k, _kinded(k)) for k in WEAK))
    both = rows.filter(_both_sides()).select("_row", strong.alias("_s"), weak.alias("_w")).distinct()
    # a strong part reaches from scope before its start to scope after its end; both sides are keyed by every bucket they
    # touch, and a pair meets in the first bucket that both touch only, so it comes once whatever its length
    bucket = lambda place: F.floor(place / config.scope)
    w = both.select("_row", F.explode("_w").alias("w")).select("_row", "w", F.explode(F.sequence(bucket(F.col("w.start")), bucket(F.col("w.end")))).alias("_b"))
    s = both.select("_row", F.explode("_s").alias("s"))
    s = s.select("_row", "s", F.explode(F.sequence(bucket(F.col("s.start") - config.scope), bucket(F.col("s.end") + config.scope))).alias("_b"))
    first = F.col("_b") == bucket(F.greatest(F.col("w.start"), F.col("s.start") - config.scope))
    near = (F.col("w.start") <= F.col("s.end") + config.scope) & (F.col("w.end") >= F.col("s.start") - config.scope)
    overlap = (F.col("w.kind") == KINDS.index("key")) & (F.col("w.start") < F.col("s.end")) & (F.col("s.start") < F.col("w.end"))
    fits = F.when(F.col("w.kind") == KINDS.index("key"), F.col("s.kind") <= KINDS.index("access")).otherwise(F.lit(True))
    hits = w.join(s, ["_row", "_b"]).filter(first & near & fits & ~overlap).select("_row", "w")
    return hits.distinct().groupBy("_row").agg(F.sort_array(F.collect_list("w")).alias("_linked"))


def scan(docs: DataFrame, config: SecretConfig = SecretConfig(), keep: list[str] | None = None) -> DataFrame:
    """doc_id, _row, base arrays, and ``spans``: all (start, kind number, end), sorted; with ``keep``, ``_keep`` too.

    Only rows with both sides are joined with the links; the others, which are nearly all, go past the join.
    """
    rows = shared_table(scan_rows(docs, keep))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    rows = rows.filter(~_both_sides()).withColumn("_linked", none).unionByName(rows.filter(_both_sides()).join(linked(rows, config), "_row", "left").withColumn("_linked", F.coalesce("_linked", none)))
    arrays = [F.transform(k, _kinded(k, last="end")) for k in BASE]
    weak = F.transform("_linked", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return rows.select("doc_id", "_row", *BASE, F.sort_array(F.concat(*arrays)).alias("base"), F.sort_array(F.concat(*arrays, weak)).alias("spans"), *(["_keep"] if keep else []))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, config: SecretConfig = SecretConfig(), mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; every found span is replaced by ``mark`` in text, and n_chars follows the text.

    The text is cut into blocks of 4,096 code points first, so taking a stretch of it costs the stretch, not the text.
    Rows without findings pass unchanged.
    """
    columns = docs.columns
    # two columns only, so that no name of the table's can clash with a helper's
    rows = scan(docs, config, columns).select("spans", "_keep")
    own = lambda c: F.col("_keep")[c]
    text, size = own("text"), 4096

    def merged(spans: Column) -> Column:
        """Spans that touch or overlap as one: a span begins one where it starts beyond all ends before it."""

        def of(reach: Column) -> Column:
            begins = F.filter(F.transform(spans, lambda s, i: F.when((i == 0) | (s["start"] > F.get(reach, i)), i)), lambda i: i.isNotNull())
            last = F.greatest(F.get(reach, F.size(spans) - 1), F.element_at(spans, -1)["end"])
            return let(begins, lambda bs: F.transform(bs, lambda i, k: F.struct(F.get(spans, i)["start"].alias("start"), F.coalesce(F.get(reach, F.get(bs, k + 1)), last).alias("end"))))

        return let(_running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(-1).cast("long")), of)

    def stretch(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / size).cast("int")
        held = F.array_join(F.slice(blocks, first + 1, F.greatest(F.floor(end / size).cast("int") - first + 1, F.lit(0))), "")
        return F.substring(held, (start - first * size + 1).cast("int"), (end - start).cast("int"))

    def rebuilt(blocks: Column, spans: Column) -> Column:
        gaps = F.transform(spans, lambda s, i: F.concat(stretch(blocks, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), s["start"]), F.lit(mark)))
        tail = let(F.element_at(spans, -1)["end"], lambda e: stretch(blocks, e, e + F.greatest(F.length(text) - e, F.lit(0))))
        return F.concat(F.array_join(gaps, ""), tail)

    new = let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)), lambda b: let(merged(F.col("spans")), lambda s: rebuilt(b, s)))
    rows = rows.withColumn("_new", F.when(F.size("spans") == 0, text).otherwise(new))
    length = F.when(F.size("spans") == 0, own("n_chars") if "n_chars" in columns else F.lit(0)).otherwise(F.length("_new"))
    made = {"text": F.col("_new")} | ({"n_chars": length.cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in columns else {})
    return rows.select(*(made.get(c, own(c)).alias(c) for c in columns))
