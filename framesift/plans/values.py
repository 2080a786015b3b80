"""Queries over single values, vectors, pairs, pools and hashsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import control as K
from ..functions import numbers as N
from ..functions import sequences as Q
from ..functions import sets as S
from ..functions import strings as T
from ..operators import choices as C
from ..operators import pools, search, tables
from ..operators.index import Index
from . import frames
from .catalog import query
from .sets import t

_POSTINGS = " UNION ".join(f"SELECT p_partkey AS oid, '{s}' AS slot, CAST({s} AS VARCHAR) AS value FROM part" for s in ("p_brand", "p_type", "p_size", "p_name"))


# numbers


@query(
    "number_tests",
    """SELECT c_custkey, c_acctbal < 0 AS negative, c_custkey % 2 = 0 AS even, c_custkey = c_nationkey AS same, CAST(c_custkey AS DOUBLE) AS inexact,
       CAST(round(c_acctbal) AS BIGINT) AS exact, CAST(ceil(c_acctbal) AS BIGINT) AS ceiling, c_custkey - 1 AS less_one, CAST(c_custkey * c_nationkey AS BIGINT) AS product FROM customer""",
)
def number_tests(spark, d):
    return t(spark, d, "customer").select(
        "c_custkey", N.is_negative("c_acctbal").alias("negative"), N.is_even("c_custkey").alias("even"), N.equal("c_custkey", "c_nationkey").alias("same"), N.exact_to_inexact("c_custkey").alias("inexact"),
        N.inexact_to_exact("c_acctbal").alias("exact"), N.ceiling("c_acctbal").cast("long").alias("ceiling"), N.decrement("c_custkey").alias("less_one"), N.multiply("c_custkey", "c_nationkey").cast("long").alias("product"),
    )


@query(
    "curves",
    """SELECT p_partkey, round(exp(p_size / 10.0), 6) AS exp, round(cos(p_size), 9) AS cos, round(tan(p_size / 50.0), 9) AS tan, round(acos(p_size / 100.0), 9) AS acos, round(atan(p_size), 9) AS atan FROM part""",
)
def curves(spark, d):
    size = F.col("p_size").cast("double")
    return t(spark, d, "part").select(
        "p_partkey", F.round(N.exp(size / 10), 6).alias("exp"), F.round(N.cos(size), 9).alias("cos"), F.round(N.tan(size / 50), 9).alias("tan"), F.round(N.acos(size / 100), 9).alias("acos"), F.round(N.atan(size), 9).alias("atan")
    )


@query(
    "simplest_fraction",
    """SELECT p_partkey, d AS den, CAST(round(p_size / 60.0 * d) AS BIGINT) AS num FROM
       (SELECT p_partkey, p_size, (SELECT min(x) FROM range(1, 1001) r(x) WHERE abs(round(p_size / 60.0 * x) / x - p_size / 60.0) <= 0.001) AS d FROM part)""",
)
def simplest_fraction(spark, d):
    q = N.rationalize(F.col("p_size") / F.lit(60.0), 0.001)
    return t(spark, d, "part").select("p_partkey", q.alias("q")).select("p_partkey", F.col("q")["den"].alias("den"), F.col("q")["num"].alias("num"))


@query(
    "kinds",
    """SELECT o_orderkey, true AS number, false AS text_number, true AS integer, false AS price_integer, true AS real, true AS rational, true AS complex, true AS complex_pair, true AS exact, true AS inexact,
       o_totalprice AS re, CAST(o_custkey AS DOUBLE) AS im FROM orders""",
)
def kinds(spark, d):
    price = F.col("o_totalprice").cast("double")
    z = F.struct(price.alias("re"), F.col("o_custkey").cast("double").alias("im"))
    return t(spark, d, "orders").select(
        "o_orderkey", N.is_number(price).alias("number"), N.is_number("o_orderstatus").alias("text_number"), N.is_integer("o_orderkey").alias("integer"), N.is_integer(price).alias("price_integer"), N.is_real(price).alias("real"),
        N.is_rational("o_orderkey").alias("rational"), N.is_complex(price).alias("complex"), N.is_complex(z).alias("complex_pair"), N.is_exact("o_orderkey").alias("exact"), N.is_inexact(price).alias("inexact"),
        N.real_part(z).alias("re"), N.imag_part(z).alias("im"),
    )


# strings


@query(
    "string_parts",
    """SELECT p_partkey, p_brand || '/' || p_type AS appended, '-----' AS made, substr(p_name, 3, 1) AS third, lower(p_type) AS down, trim('  ' || p_name || ' ') AS trimmed, upper(p_name) AS symbol, p_name AS copy,
       p_name = '' AS empty, NOT regexp_matches(p_type, '[a-z]') AS upper, regexp_matches(CAST(p_size AS VARCHAR), '^[0-9]*$') AS digits, 'zz' || substr(p_brand, 3) AS begun, repeat('*', length(p_brand)) AS filled FROM part""",
)
def string_parts(spark, d):
    begun = T.string_set(T.string_set("p_brand", 0, "z"), 1, "z")
    return t(spark, d, "part").select(
        "p_partkey", T.string_append("p_brand", F.lit("/"), "p_type").alias("appended"), T.make_string(5, "-").alias("made"), T.string_ref("p_name", 2).alias("third"), T.string_downcase("p_type").alias("down"),
        T.string_trim(T.string_append(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"), T.symbol("p_name").alias("symbol"), T.string_copy("p_name").alias("copy"), T.is_empty_string("p_name").alias("empty"),
        T.is_uppercase("p_type").alias("upper"), T.is_numeric(F.col("p_size").cast("string")).alias("digits"), begun.alias("begun"), T.string_fill("p_brand", "*").alias("filled"),
    )


@query(
    "characters",
    """SELECT DISTINCT c, unicode(c) AS code, c AS back, regexp_matches(c, '^[A-Za-z]$') AS alphabetic, regexp_matches(c, '^[0-9]$') AS numeric, regexp_matches(c, '^[A-Za-z0-9]$') AS alphanumeric,
       regexp_matches(c, '^[ \\t\\n\\r\\f\\v]$') AS whitespace, regexp_matches(c, '^[A-Z]$') AS upper, regexp_matches(c, '^[a-z]$') AS lower FROM (SELECT unnest(string_split(p_name || p_type || p_brand, '')) AS c FROM part) WHERE c <> ''""",
)
def characters(spark, d):
    c = t(spark, d, "part").select(F.explode(F.split(F.concat("p_name", "p_type", "p_brand"), "")).alias("c")).filter("c <> ''").distinct()
    classes = {"alphabetic": "alphabetic", "numeric": "numeric", "alphanumeric": "alphanumeric", "whitespace": "whitespace", "upper-case": "upper", "lower-case": "lower"}
    return c.select("c", T.char_to_integer("c").alias("code"), T.integer_to_char(T.char_to_integer("c")).alias("back"), *(T.char_class(k, "c").alias(v) for k, v in classes.items()))


@query("packets", "SELECT p_partkey, p_name AS text, 'AB' AS literal, 'Xrand' || substr(p_brand, 6) AS changed, true AS valid, p_name AS patched, '&lt;' || p_brand AS escaped, '<' || p_brand AS plain FROM part")
def packets(spark, d):
    as_bytes = T.string_to_packet("p_brand")
    escaped = F.concat(F.lit("&lt;"), "p_brand")
    return t(spark, d, "part").select(
        "p_partkey", T.packet_to_string(T.string_to_packet("p_name")).alias("text"), T.packet_to_string(T.packet(65, 66)).alias("literal"), T.packet_to_string(T.packet_set(as_bytes, 0, 88)).alias("changed"),
        T.is_valid_utf8("p_name").alias("valid"), T.patch_utf8("p_name").alias("patched"), escaped.alias("escaped"), T.convert_entities(escaped).alias("plain"),
    )


# vectors and pairs

_VECTOR = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"


@query(
    "vector_parts",
    f"""SELECT vec_id, v[3] AS third, v[4] AS fourth, v[5] AS fifth, array_to_string(v[2:4], ',') = array_to_string([v[2], v[3], v[4]], ',') AS sub_same, len(v) + 1 AS consed, v[1] AS cons_second,
        CAST(0 AS DOUBLE) AS changed_first, len(v) - 2 AS tail, true AS found, CAST(1 AS INTEGER) AS differ, CAST(2 AS INTEGER) AS part_at FROM ({_VECTOR}) WHERE len(list_distinct(v[1:5])) = 5""",
)
def vector_parts(spark, d):
    rows = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.size(F.array_distinct(F.slice("v", 1, 5))) == 5)
    changed, consed = Q.set_elt("v", 0, 0.0), Q.cons(F.lit(1.0), "v")
    same = Q.subseq("v", 1, 4) == Q.vector(Q.second("v"), Q.third("v"), Q.fourth("v"))
    return rows.select(
        "vec_id", Q.third("v").alias("third"), Q.fourth("v").alias("fourth"), Q.fifth("v").alias("fifth"), same.alias("sub_same"), F.size(consed).alias("consed"), Q.second(consed).alias("cons_second"), Q.first(changed).alias("changed_first"),
        F.size(Q.member(Q.third("v"), "v")).alias("tail"), Q.find(Q.fifth("v"), "v").alias("found"), Q.mismatch("v", Q.set_elt("v", 1, 1e9)).alias("differ"), Q.search(Q.subseq("v", 2, 4), "v").alias("part_at"),
    )


@query(
    "built_vectors",
    """SELECT n_nationkey, [n_nationkey, n_regionkey] = [n_nationkey, n_regionkey] AS plain, CAST(n_nationkey + n_regionkey AS BIGINT) AS listed, CAST(3 * n_regionkey AS BIGINT) AS repeated, CAST(n_nationkey * 6 AS BIGINT) AS steps,
       CAST(21 AS BIGINT) AS filled, CAST(n_nationkey * n_regionkey AS BIGINT) AS zipped, CAST(0 AS BIGINT) AS zeros, n_nationkey + n_regionkey + 0.5 AS doubles FROM nation""",
)
def built_vectors(spark, d):
    total = lambda a, kind="bigint": F.aggregate(a.cast(f"array<{kind}>"), F.lit(0).cast(kind), lambda x, y: x + y)
    two = Q.vector("n_nationkey", "n_regionkey")
    return t(spark, d, "nation").select(
        "n_nationkey", (two == Q.list_("n_nationkey", "n_regionkey")).alias("plain"), total(Q.list_star("n_nationkey", Q.list_("n_regionkey"))).alias("listed"), total(Q.make_vector(3, F.col("n_regionkey"))).alias("repeated"),
        total(Q.dotimes(4, lambda i: i * F.col("n_nationkey"))).alias("steps"), total(Q.vector_fill(Q.make_vector(3, 1), 7)).alias("filled"),
        total(Q.map2(lambda a, b: a * b, Q.vector("n_nationkey"), Q.vector("n_regionkey", "n_nationkey"))).alias("zipped"), total(Q.make_typed_vector("int", 4)).alias("zeros"),
        total(Q.typed_vector("double", "n_nationkey", "n_regionkey", F.lit(0.5)), "double").alias("doubles"),
    )


@query(
    "pairs_and_records",
    """SELECT n_nationkey, n_name AS car, n_regionkey AS cdr, 'x' AS car_set, CAST(9 AS BIGINT) AS cdr_set, least(n_name, 'INDIA') AS least_car, 'nation' AS tag, n_name AS data, CAST(NULL AS VARCHAR) AS other,
       true AS is_pair, true AS is_record, true AS is_vector, true AS is_string, true AS is_boolean, true AS is_packet, true AS is_map, false AS is_null FROM nation""",
)
def pairs_and_records(spark, d):
    p, r = Q.pair("n_name", "n_regionkey"), Q.make_record("nation", "n_name")
    ordered = Q.sort_by_car(F.array(p, Q.pair(F.lit("INDIA"), "n_regionkey")))
    return t(spark, d, "nation").select(
        "n_nationkey", Q.car(p).alias("car"), Q.cdr(p).alias("cdr"), Q.car(Q.set_car(p, "x")).alias("car_set"), Q.cdr(Q.set_cdr(p, F.lit(9).cast("long"))).alias("cdr_set"), Q.car(F.get(ordered, F.lit(0))).alias("least_car"),
        Q.record_tag(r).alias("tag"), Q.record_data(r, "nation").alias("data"), Q.record_data(r, "region").alias("other"), Q.is_pair(p).alias("is_pair"), Q.is_record(r).alias("is_record"), Q.is_vector(F.array("n_name")).alias("is_vector"),
        Q.is_string("n_name").alias("is_string"), Q.is_boolean(F.lit(True)).alias("is_boolean"), Q.is_packet(F.encode("n_name", "UTF-8")).alias("is_packet"), Q.is_slotmap(F.create_map("n_name", "n_regionkey")).alias("is_map"), Q.is_null("n_name").alias("is_null"),
    )


@query(
    "branches",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state, CASE WHEN o_orderstatus <> 'F' THEN 'open' END AS unless, o_orderstatus = 'F' OR o_totalprice > 200000 AS either, o_orderpriority AS checked, o_custkey AS bound FROM orders""",
)
def branches(spark, d):
    done = F.col("o_orderstatus") == "F"
    return t(spark, d, "orders").select(
        "o_orderkey", K.if_(done, "done", "open").alias("state"), K.unless(done, "open").alias("unless"), K.or_(done, F.col("o_totalprice") > 200000).alias("either"),
        K.raise_exception(F.col("o_orderkey") < 0, "no such order", F.col("o_orderpriority")).alias("checked"), K.values(who=F.col("o_custkey"))["who"].alias("bound"),
    )


# choices


@query(
    "choice_forms",
    """WITH g AS (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderpriority)) AS s FROM orders GROUP BY 1)
       SELECT k, array_to_string(s, ',') AS whole, CAST(0 AS INTEGER) AS failed, len(s) > 3 AS satisfied, list_contains(s, '1-URGENT') AS urgent, 2 * len(s) AS doubled, array_to_string(list_reverse(s), ',') AS by_key, true AS proper, true AS none FROM g""",
)
def choice_forms(spark, d):
    g = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("s"))
    both = S.for_choices_flat("s", lambda x: F.array(x, F.concat(x, F.lit("!"))))
    return g.select(
        "k", F.array_join(S.proper_choice("s"), ",").alias("whole"), F.size(S.fail()).alias("failed"), S.satisfied(F.size("s") > 3).alias("satisfied"), S.exists_where("s", lambda x: x.startswith("1"), lambda x: x.endswith("URGENT")).alias("urgent"),
        F.size(both).alias("doubled"), F.array_join(S.sorted_by("s", lambda x: -F.substring(x, 1, 1).cast("int")), ",").alias("by_key"), S.is_proper_choice("s").alias("proper"), S.is_empty(S.fail()).alias("none"),
    )


@query("sorted_values", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
def sorted_values(spark, d):
    return C.sorted_(t(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal"), F.col("c_custkey"))


@query("do_results", "SELECT s_suppkey, upper(s_name) AS name FROM supplier")
def do_results(spark, d):
    def body(batches):
        for b in batches:
            yield b.assign(name=b["s_name"].str.upper())[["s_suppkey", "name"]]

    return C.do_results(t(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name"), body, "s_suppkey long, name string")


@query("pick_one", "SELECT CAST(1 AS BIGINT) AS picked, CAST(1 AS BIGINT) AS known")
def pick_one(spark, d):
    people = t(spark, d, "customer").select("c_custkey")
    one = C.pick_n(people, 1, seed=3).withColumn("one", F.lit(1))
    return people.join(one, "c_custkey", "left").agg(F.sum("one").alias("picked"), F.count_distinct(F.when(F.col("one") == 1, F.col("c_custkey"))).alias("known"))


# indices


@query("index_features", f"{_POSTINGS} UNION SELECT p_partkey, 'cheap', 'yes' FROM part WHERE p_retailprice < 1000")
def index_features(spark, d):
    cheap = t(spark, d, "part").filter("p_retailprice < 1000").select(F.col("p_partkey").alias("oid"), F.lit("cheap").alias("slot"), F.lit("yes").alias("value"))
    return Index.index_frames(frames.parts(spark, d)).add_rows(cheap).features()


@query("index_prefetch", "SELECT p_partkey AS oid, 'p_brand' AS slot, p_brand AS value FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 1)")
def index_prefetch(spark, d):
    brands = t(spark, d, "part").select(F.col("p_partkey").alias("oid"), F.lit("p_brand").alias("slot"), F.col("p_brand").alias("value"), "p_size")
    return Index.index_values(brands).prefetch(brands.filter("p_size = 1")).select("oid", "slot", "value")


@query("scores_of_many_clauses", "SELECT s_suppkey AS oid, CAST((s_nationkey BETWEEN 0 AND 24) AS BIGINT) + CAST(s_nationkey % 5 = 0 AS BIGINT) AS score FROM supplier")
def scores_of_many_clauses(spark, d):
    rows = t(spark, d, "supplier").select(F.col("s_suppkey").alias("oid"), F.lit("nation").alias("slot"), F.col("s_nationkey").cast("string").alias("value"))
    clauses = [("nation", [n]) for n in range(70)] + [("nation", list(range(0, 25, 5)))]
    return search.scores(Index.index_values(rows), *clauses)


# pools and tables


@query(
    "pool_tests",
    """SELECT o_orderkey AS oid, o_orderkey BETWEEN 100 AND 1099 AS inside, o_orderkey + 16 AS plus, o_orderkey - o_custkey AS apart, CAST(sign(o_orderkey - o_custkey) AS INTEGER) AS compared FROM orders""",
)
def pool_tests(spark, d):
    oid, other = F.col("o_orderkey"), F.col("o_custkey")
    return t(spark, d, "orders").select(oid.alias("oid"), pools.in_pool(oid, 100, 1000).alias("inside"), pools.oid_plus(oid, 16).alias("plus"), pools.oid_difference(oid, other).alias("apart"), pools.compare_oids(oid, other).alias("compared"))


@query("same_pool", "SELECT DISTINCT o_orderkey AS a, o_custkey AS b, (o_orderkey < 60000 AND o_custkey < 60000 AND o_orderkey // 100 = o_custkey // 100) AS same FROM orders")
def same_pool(spark, d):
    ranges = pools.allocate_ranges((0, 60000), 0, [(f"pool{i}", 100) for i in range(600)])
    return pools.in_same_pool(t(spark, d, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b")), pools.catalog(spark, ranges))


@query("pool_values", "SELECT c_custkey AS oid, CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE c_name END AS value FROM customer")
def pool_values(spark, d):
    pool = t(spark, d, "customer").select(F.col("c_custkey").alias("oid"), F.col("c_name").alias("value"), "c_acctbal")
    return pools.set_oid_value(pool.select("oid", "value"), pool.filter("c_acctbal < 0").select("oid", F.lit("debtor").alias("value")))


@query("hashset_zap", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def hashset_zap(spark, d):
    key = lambda name, c: t(spark, d, name).select(F.col(c).cast("long").alias("k"))
    members = tables.hashset(key("customer", "c_nationkey"), key("supplier", "s_nationkey"))
    return tables.hashset_zap(members, t(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("k")))


@query("hashset_contains", "SELECT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')) AS contains")
def hashset_contains(spark, d):
    members = tables.hashset(t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")))
    return tables.hashset_contains(members, t(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), ["k"])


@query("hashtable_values", "SELECT DISTINCT v AS value FROM (SELECT max(o_totalprice) AS v FROM orders GROUP BY o_custkey)")
def hashtable_values(spark, d):
    return tables.values(tables.hashtable(t(spark, d, "orders"), "o_custkey", "o_totalprice"))


@query("hashtable_sets", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer GROUP BY 1")
def hashtable_sets(spark, d):
    return tables.add_sets(t(spark, d, "customer"), ["c_nationkey"], "c_mktsegment").select("c_nationkey", F.array_join("c_mktsegment", ",").alias("segments"))
