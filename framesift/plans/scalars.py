"""Queries over numbers, strings, patterns and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import control as K
from ..functions import numbers as N
from ..functions import patterns as P
from ..functions import sequences as Q
from ..functions import strings as S
from ..functions import text as X
from .catalog import query
from .sets import t


def docs(spark, d):
    return t(spark, d, "documents").select("doc_id", "text")


@query("integer_arithmetic", "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey - 1000 AS less, (l_partkey - 1000) // 7 AS quotient, (l_partkey - 1000) % 7 AS remainder, ((l_partkey - 1000) % 7 + 7) % 7 AS modulo, gcd(l_partkey, 360) AS gcd, lcm(l_partkey, 12) AS lcm FROM lineitem")
def integer_arithmetic(spark, d):
    less = N.subtract("l_partkey", 1000)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", less.alias("less"), N.quotient(less, 7).alias("quotient"), N.remainder(less, 7).alias("remainder"), N.modulo(less, 7).alias("modulo"), N.gcd("l_partkey", 360).alias("gcd"), N.lcm("l_partkey", 12).alias("lcm"))


@query("exact_division", "SELECT p_partkey, CAST(p_size // gcd(p_size, 12) AS BIGINT) AS num, CAST(12 // gcd(p_size, 12) AS BIGINT) AS den, p_size / 12 AS quotient FROM part")
def exact_division(spark, d):
    q = N.divide("p_size", 12)
    return t(spark, d, "part").select("p_partkey", N.numerator(q).alias("num"), N.denominator(q).alias("den"), N.float_divide("p_size", 12).alias("quotient"))


@query("rounding", "SELECT c_custkey, floor(c_acctbal) AS floor, ceil(c_acctbal) AS ceiling, trunc(c_acctbal) AS truncated, round(c_acctbal / 25) * 25 + 0.0 AS by_unit, abs(c_acctbal) AS magnitude FROM customer")
def rounding(spark, d):
    b = F.col("c_acctbal")
    return t(spark, d, "customer").select("c_custkey", F.floor(b).alias("floor"), F.ceil(b).alias("ceiling"), N.truncate(b).alias("truncated"), N.round_to(b, 25).alias("by_unit"), N.magnitude(b).alias("magnitude"))


@query("scalerep_buckets", "SELECT CAST(round(p_retailprice / 50) * 50 AS BIGINT) AS bucket, count(*) AS n FROM part GROUP BY 1")
def scalerep_buckets(spark, d):
    return t(spark, d, "part").select(N.scalerep("p_retailprice", 50)["bucket"].alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("transcendentals", "SELECT p_partkey, round(ln(p_size), 9) AS log, round(sqrt(p_size), 9) AS sqrt, round(sin(p_size), 9) AS sin, round(atan2(p_size, 10), 9) AS atan2, round(pow(p_size, 1.5), 6) AS expt, CAST(ceil(log2(p_size)) AS INTEGER) AS ilog FROM part")
def transcendentals(spark, d):
    x = F.col("p_size")
    return t(spark, d, "part").select("p_partkey", F.round(F.log(x), 9).alias("log"), F.round(F.sqrt(x), 9).alias("sqrt"), F.round(F.sin(x), 9).alias("sin"), F.round(F.atan2(x, F.lit(10)), 9).alias("atan2"), F.round(N.expt(x, F.lit(1.5)), 6).alias("expt"), N.ilog(x).alias("ilog"))


@query("numeric_predicates", "SELECT p_size, p_size = 0 AS zero, p_size > 25 AS above, p_size % 2 = 1 AS odd, 5 < p_size AND p_size < 20 AS chain, least(p_size, 10) AS low, greatest(p_size, 10) AS high, count(*) AS n FROM part GROUP BY 1")
def numeric_predicates(spark, d):
    x = F.col("p_size")
    return t(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n")).select("p_size", N.is_zero(x).alias("zero"), N.is_positive(x - 25).alias("above"), N.is_odd(x).alias("odd"), N.compare_chain("<", 5, x, 20).alias("chain"), N.minimum(x, 10).alias("low"), N.maximum(x, 10).alias("high"), "n")


@query("number_strings", "SELECT p_partkey, printf('%.2f', p_retailprice) AS fixed, lower(to_base(p_partkey, 16)) AS hex, lower(to_base(p_partkey, 2)) AS bin, p_partkey AS back FROM part")
def number_strings(spark, d):
    return t(spark, d, "part").select("p_partkey", N.inexact_to_string("p_retailprice", 2).alias("fixed"), N.number_to_string("p_partkey", 16).alias("hex"), N.number_to_string("p_partkey", 2).alias("bin"), N.string_to_number(N.number_to_string("p_partkey", 36), 36).alias("back"))


@query("bitwise", "SELECT p_partkey, p_partkey & 255 AS a, p_partkey | 255 AS o, xor(p_partkey, 255) AS x FROM part")
def bitwise(spark, d):
    from ..functions import sets as C

    m = F.lit(255).cast("long")
    return t(spark, d, "part").select("p_partkey", C.log_and("p_partkey", m).alias("a"), C.log_ior("p_partkey", m).alias("o"), C.log_xor("p_partkey", m).alias("x"))


@query("random_below", None)
def random_below(spark, d):
    return t(spark, d, "part").select("p_partkey", N.random_below(10, 42, "p_partkey").alias("r"))


# strings


@query("string_basics", "SELECT p_partkey, length(p_name) AS len, substring(p_name, 2, 3) AS part, p_type || '/' || p_brand AS joined, upper(p_name) AS up, reverse(p_name) AS back, starts_with(p_name, 's') AS pre, suffix(p_name, 't') AS post, contains(p_name, 'ed') AS has, replace(p_name, 'ring', 'RING') AS subst FROM part")
def string_basics(spark, d):
    return t(spark, d, "part").select(
        "p_partkey", S.string_length("p_name").alias("len"), S.substring("p_name", 1, 4).alias("part"), S.space_append("/", "p_type", "p_brand").alias("joined"), S.string_upcase("p_name").alias("up"), S.list_to_string(F.reverse(S.string_to_list("p_name"))).alias("back"),
        S.has_prefix("s", "p_name").alias("pre"), S.has_suffix("t", "p_name").alias("post"), S.string_contains("p_name", "ed").alias("has"), S.string_subst("p_name", "ring", "RING").alias("subst"),
    )


@query("string_order", "SELECT a.n_name AS a, b.n_name AS b, a.n_name < b.n_name AS less, lower(a.n_name) = lower(b.n_name) AS same FROM nation a, nation b")
def string_order(spark, d):
    n = t(spark, d, "nation")
    pairs = n.select(F.col("n_name").alias("a")).crossJoin(n.select(F.col("n_name").alias("b")))
    return pairs.select("a", "b", S.string_compare("<", "a", "b").alias("less"), S.string_compare("=", "a", "b", ci=True).alias("same"))


@query("char_counts", "SELECT doc_id, length(text) AS n, CAST(floor(100 * length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text)) AS INTEGER) AS alphabetic, CAST(floor(100 * length(regexp_replace(text, '[^\\p{L}\\p{Nd}]', '', 'g')) / length(text)) AS INTEGER) AS alphanumeric FROM documents WHERE length(text) > 0")
def char_counts(spark, d):
    return docs(spark, d).filter("length(text) > 0").select("doc_id", F.length("text").alias("n"), S.alphabetic_percent("text").alias("alphabetic"), S.alphanumeric_percent("text").alias("alphanumeric"))


@query("std_space", r"SELECT doc_id, md5(regexp_replace(trim(text, E' \t\n\r'), '\s+', ' ', 'g')) AS clean FROM documents")
def std_space(spark, d):
    return docs(spark, d).select("doc_id", S.md5(S.std_space("text")).alias("clean"))


@query("string_predicates", r"SELECT turn, role, regexp_matches(text, '^\p{Lu}') AS capitalized, NOT regexp_matches(text, '\p{Lu}') AS lowercase, contains(text, chr(10)) AS multi_line, count(*) AS n FROM conversations GROUP BY ALL")
def string_predicates(spark, d):
    c = t(spark, d, "conversations").select("turn", "role", S.is_capitalized("text").alias("capitalized"), S.is_lowercase("text").alias("lowercase"), S.is_multi_line("text").alias("multi_line"))
    return c.groupBy(*c.columns).agg(F.count("*").alias("n"))


@query("string_capitalize", "SELECT DISTINCT p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part")
def string_capitalize(spark, d):
    return t(spark, d, "part").select("p_name").distinct().select("p_name", S.string_capitalize("p_name").alias("title"))


@query("bigram_set", "SELECT p_name, array_to_string(list_sort(list_distinct(list_transform(range(1, length(p_name)), lambda i: substring(lower(p_name), i, 2)))), '|') AS bigrams, len(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substring(lower(p_name), i, 3)))) AS trigrams FROM (SELECT DISTINCT p_name FROM part)")
def bigram_set(spark, d):
    return t(spark, d, "part").select("p_name").distinct().select("p_name", F.array_join(S.get_bigrams("p_name"), "|").alias("bigrams"), F.size(S.get_trigrams("p_name")).alias("trigrams"))


@query("bigram_index", "SELECT g AS value, count(DISTINCT c_custkey) AS n FROM (SELECT c_custkey, unnest(list_transform(range(1, length(c_name)), lambda i: substring(lower(c_name), i, 2))) AS g FROM customer) GROUP BY 1")
def bigram_index(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.explode(S.get_bigrams("c_name")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


@query("columnize", "SELECT c_custkey, substring(c_name, 1, 8) AS kind, substring(c_name, 10) AS number FROM customer")
def columnize(spark, d):
    cols = S.columnize("c_name", [1, 9])
    return t(spark, d, "customer").select("c_custkey", cols[0].alias("kind"), F.substring(cols[1], 2, 100).alias("number"))


@query("strip_margin", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^[^\p{L}\p{Nd}]+', ''), '([^\p{L}\p{Nd}])[^\p{L}\p{Nd}]+', '\1', 'g')) AS stripped FROM documents")
def strip_margin(spark, d):
    return docs(spark, d).select("doc_id", F.md5(S.strip_margin("text")).alias("stripped"))


@query("suffix_rule", "SELECT DISTINCT w, substring(w, 1, length(w) - 2) AS root FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w LIKE '%et' AND length(w) > 2")
def suffix_rule(spark, d):
    w = t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return w.select("w", F.explode(S.suffix_rule("w", [("et", "")])).alias("root"))


@query("english_stem", None)
def english_stem(spark, d):
    w = t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return w.select("w", X.english_stem("w").alias("stem"))


@query("get_names", None)
def get_names(spark, d):
    return docs(spark, d).select("doc_id", F.explode(X.get_names("text")).alias("name"))


@query("get_times", "SELECT event_id, list_sort(list_distinct([strftime(ts, '%H:%M'), strftime(ts, '%Y-%m-%d'), 'noon'])) AS times FROM events")
def get_times(spark, d):
    ts = lambda f: F.date_format("ts", f)
    text = F.concat(F.lit("It was seen on "), ts("yyyy-MM-dd"), F.lit(" at "), ts("HH:mm"), F.lit(", long after noon, as a "), "event_type")
    return t(spark, d, "events").select("event_id", X.get_times(text).alias("times"))


@query("string_base", "SELECT DISTINCT word, strip_accents(word) AS base FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations) WHERE regexp_matches(word, '^[a-zéèêçñíóúüöäA-ZÉ]+$')")
def string_base(spark, d):
    w = t(spark, d, "conversations").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return w.filter(F.col("word").rlike("^[a-zéèêçñíóúüöäA-ZÉ]+$")).select("word", S.string_base("word").alias("base"))


@query("digests", "SELECT doc_id, md5(text) AS digest FROM documents")
def digests(spark, d):
    return docs(spark, d).select("doc_id", S.md5("text").alias("digest"))


@query("packets", "SELECT p_partkey, lower(hex(encode(p_name))) AS bytes, ascii(p_name) AS first, octet_length(encode(p_name)) AS n, p_partkey AS back FROM part")
def packets(spark, d):
    b = S.string_to_packet("p_name")
    return t(spark, d, "part").select("p_partkey", F.lower(F.hex(S.vector_to_packet(S.packet_to_vector(b)))).alias("bytes"), S.packet_ref(b, 0).alias("first"), F.size(S.packet_to_vector(b)).alias("n"), S.packet_to_uint(S.uint_to_packet("p_partkey", 8)).alias("back"))


@query("uri_coding", "SELECT page_id, url_encode(url) AS encoded, url AS decoded FROM pages")
def uri_coding(spark, d):
    return t(spark, d, "pages").select("page_id", S.uri_encode("url").alias("encoded"), S.uri_decode(S.uri_encode("url")).alias("decoded"))


@query("gather_mail", r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z0-9]'))) AS mail FROM documents")
def gather_mail(spark, d):
    return docs(spark, d).select("doc_id", F.explode(S.get_mail_ids("text")).alias("mail"))


# patterns


@query("tx_match", r"SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '(?i)(small|red|blue) [a-z]+')")
def tx_match(spark, d):
    return t(spark, d, "part").filter(P.tx_match(P.seq({"small", "red", "blue"}, " ", P.one_or_more(P.ISALPHA)), "p_name")).select("p_partkey")


@query("tx_search", r"SELECT doc_id, strpos(lower(text), 'license') - 1 AS place FROM documents WHERE strpos(lower(text), 'license') > 0")
def tx_search(spark, d):
    return docs(spark, d).select("doc_id", P.tx_search("license", "text").alias("place")).filter("place is not null")


@query("tx_extract", r"SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#([0-9]+)', 1) AS kind, regexp_extract(c_name, '([A-Za-z]+)#([0-9]+)', 2) AS number FROM customer")
def tx_extract(spark, d):
    p = P.seq(P.label("kind", P.one_or_more(P.ISALPHA)), "#", P.label("number", P.one_or_more(P.ISDIGIT)))
    return t(spark, d, "customer").select("c_custkey", P.tx_extract(p, "c_name").alias("m")).select("c_custkey", "m.kind", "m.number")


@query("tx_subst", r"SELECT c_custkey, regexp_replace(c_name, '#0*', ' no. ') AS name FROM customer")
def tx_subst(spark, d):
    return t(spark, d, "customer").select("c_custkey", P.tx_subst(P.subst(P.seq("#", P.star("0")), " no. "), "c_name").alias("name"))


@query("tx_matcher", r"SELECT doc_id, length(regexp_extract(text, '^\p{L}+')) AS ends FROM documents WHERE regexp_matches(text, '^\p{L}+')")
def tx_matcher(spark, d):
    return docs(spark, d).select("doc_id", P.tx_matcher(P.one_or_more(P.ISALPHA), "text").alias("ends")).filter("ends is not null")


@query("gather_numbers", r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]{3,}'))) AS number FROM documents")
def gather_numbers(spark, d):
    three = P.seq(P.char_range("0", "9"), P.char_range("0", "9"), P.plus(P.char_range("0", "9")))
    return docs(spark, d).select("doc_id", F.explode(P.gather(three, "text")).alias("number"))


@query("segment", r"SELECT turn, count(*) AS n, CAST(sum(len(regexp_extract_all(text, '[\p{L}\p{Nd}]+'))) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def segment(spark, d):
    return t(spark, d, "conversations").groupBy("turn").agg(F.count("*").alias("n"), F.sum(F.size(P.segment("text"))).alias("tokens"))


@query("fragment", "SELECT p_partkey, length(p_name) - length(replace(p_name, ' ', '')) AS seps, p_name AS whole FROM part")
def fragment(spark, d):
    f = P.fragment("p_name")
    return t(spark, d, "part").select("p_partkey", F.size(F.filter(f, lambda x: x == " ")).alias("seps"), F.array_join(f, "").alias("whole"))


# sequences


@query("sequence_access", "SELECT vec_id, embedding[1] AS first, embedding[2] AS second, len(embedding) AS n, embedding[len(embedding)] AS last, list_position(embedding, embedding[7]) - 1 AS place FROM embeddings")
def sequence_access(spark, d):
    e = t(spark, d, "embeddings")
    return e.select("vec_id", Q.first("embedding").alias("first"), Q.second("embedding").alias("second"), Q.vector_length("embedding").alias("n"), Q.first(Q.reverse("embedding")).alias("last"), Q.position(Q.elt("embedding", 6), "embedding").alias("place"))


@query("sequence_maps", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS positive, list_bool_or(list_transform(embedding, lambda x: x > 0.3)) AS some, list_bool_and(list_transform(embedding, lambda x: x < 0.9)) AS every, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS sumsq FROM embeddings")
def sequence_maps(spark, d):
    sq = F.aggregate(Q.map_(lambda x: x.cast("double") * x, "embedding"), F.lit(0.0), lambda a, x: a + x)
    return t(spark, d, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).alias("positive"), Q.some(lambda x: x > 0.3, "embedding").alias("some"), Q.every(lambda x: x < 0.9, "embedding").alias("every"), F.round(sq, 4).alias("sumsq"))


@query("sequence_edits", "SELECT p_partkey, array_to_string(list_concat(w, ['end']), '-') AS appended, array_to_string(list_reverse(w), '-') AS reversed, array_to_string(w[2:], '-') AS tail, array_to_string(list_filter(w, lambda x: x <> 'ring'), '-') AS removed, len(list_filter(w, lambda x: x = 'red')) AS reds FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def sequence_edits(spark, d):
    w = t(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    j = lambda c: F.array_join(c, "-")
    return w.select("p_partkey", j(Q.append("w", F.array(F.lit("end")))).alias("appended"), j(Q.reverse("w")).alias("reversed"), j(Q.list_tail("w", 1)).alias("tail"), j(Q.remove("ring", "w")).alias("removed"), Q.count("red", "w").alias("reds"))


@query("assoc_lookup", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def assoc_lookup(spark, d):
    m = F.from_json("props", "map<string,int>")
    return t(spark, d, "events").select("event_id", Q.assoc("k", m).alias("k"))


# conditions and text output


@query("conditions", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS kind, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 1 WHEN p_type = 'SMALL' THEN 2 ELSE 0 END AS code, NOT (p_size > 5) AS low, p_size > 5 AND p_size < 9 AS mid FROM part")
def conditions(spark, d):
    x = F.col("p_size")
    return t(spark, d, "part").select("p_partkey", K.cond((x < 10, "small"), (x < 30, "middle"), otherwise="large").alias("kind"), K.case(F.col("p_type"), (["PROMO", "ECONOMY"], 1), (["SMALL"], 2), otherwise=0).alias("code"), K.not_(x > 5).alias("low"), K.and_(x > 5, x < 9).alias("mid"))


@query("comma_list", "SELECT n_regionkey, array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[len(l)] AS names FROM (SELECT n_regionkey, list_sort(list(n_name)) AS l FROM nation GROUP BY 1)")
def comma_list(spark, d):
    g = t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return g.select("n_regionkey", K.comma_list(F.col("l")).alias("names"))


@query("stringout", "SELECT c_custkey, c_name || ' (' || c_nationkey || ')' AS line FROM customer")
def stringout(spark, d):
    return t(spark, d, "customer").select("c_custkey", K.stringout(F.col("c_name"), " (", F.col("c_nationkey"), ")").alias("line"))


@query("cgi_vars", "SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref FROM pages WHERE regexp_matches(url, '[?&]page=')")
def cgi_vars(spark, d):
    m = K.cgi_vars(F.regexp_extract("url", r"[?]([^#]*)", 1))
    return t(spark, d, "pages").select("page_id", m.alias("m")).select("page_id", F.col("m")["page"].alias("page"), F.col("m")["ref"].alias("ref")).filter("page is not null")


@query("paths", "SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS base, regexp_replace(url, '/?[^/]*/*$', '') AS dir FROM pages")
def paths(spark, d):
    return t(spark, d, "pages").select("page_id", K.basename(F.col("url")).alias("base"), K.dirname(F.col("url")).alias("dir"))


@query("complex_magnitude", "SELECT c_custkey, round(sqrt(c_acctbal * c_acctbal + c_nationkey * c_nationkey), 6) AS modulus FROM customer")
def complex_magnitude(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.round(N.complex_magnitude(N.make_rectangular("c_acctbal", "c_nationkey")), 6).alias("modulus"))


@query("nd_call", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority))[-1] AS last FROM orders GROUP BY 1")
def nd_call(spark, d):
    from ..operators import choices

    return choices.nd_call(t(spark, d, "orders"), ["o_custkey"], "o_orderpriority", lambda s: F.element_at(s, -1), "last")


@query("parallel_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def parallel_union(spark, d):
    from ..operators import choices

    return choices.parallel(lambda: t(spark, d, "nation").select(F.col("n_name").alias("name")), lambda: t(spark, d, "region").select(F.col("r_name").alias("name")))


@query("token_dictionary", "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) AS w FROM conversations) WHERE w IN ('the', 'of', 'der', 'que') GROUP BY 1")
def token_dictionary(spark, d):
    """HASHSET in a pattern: tokens, then a semi join with the dictionary."""
    from ..operators import tables

    words = t(spark, d, "conversations").select(F.explode(P.segment(F.lower("text"))).alias("w"))
    known = spark.createDataFrame([("the",), ("of",), ("der",), ("que",)], "w string")
    return tables.increment(words.join(known, "w", "left_semi"), ["w"]).withColumnRenamed("value", "n")
