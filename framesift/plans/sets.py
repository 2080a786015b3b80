"""Queries over sets, quantifiers and keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import order
from ..functions import sets as S
from ..operators import choices as C
from ..operators import tables as T
from .catalog import query


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cust(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("custkey"))


def _buyers(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").alias("custkey"))


@query("choice_union", "SELECT c_custkey AS custkey FROM customer WHERE c_acctbal > 5000 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def choice_union(spark, d):
    return C.choice(_rich(spark, d), t(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("custkey")))


def _rich(spark, d):
    return t(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("custkey"))


@query("choice_intersection", "SELECT c_custkey AS custkey FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def choice_intersection(spark, d):
    return C.intersection(_rich(spark, d), t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey")))


@query("choice_difference", "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def choice_difference(spark, d):
    return C.difference(_cust(spark, d), t(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey")))


@query("choice_identical", "SELECT NOT EXISTS (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer) AND NOT EXISTS (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation) AS identical")
def choice_identical(spark, d):
    return C.identical(t(spark, d, "nation").select(F.col("n_nationkey").alias("k")), t(spark, d, "customer").select(F.col("c_nationkey").alias("k")))


@query("choice_contains", "SELECT NOT EXISTS (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) AS contains")
def choice_contains(spark, d):
    return C.contains(_buyers(spark, d), _cust(spark, d))


@query("choice_overlaps", "SELECT EXISTS (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0 INTERSECT SELECT c_nationkey FROM customer) AS overlaps")
def choice_overlaps(spark, d):
    return C.overlaps(t(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("k")), t(spark, d, "customer").select(F.col("c_nationkey").alias("k")))


@query(
    "try_fallback",
    """SELECT c_custkey AS custkey, coalesce(o.v, c_mktsegment) AS v FROM customer
       LEFT JOIN (SELECT DISTINCT o_custkey, o_orderpriority AS v FROM orders WHERE o_totalprice > 400000) o ON o_custkey = c_custkey""",
)
def try_fallback(spark, d):
    first = t(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("v")).distinct()
    return C.try_(["custkey"], first, t(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("v")))


@query("exists_filter", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)")
def exists_filter(spark, d):
    sub = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return C.exists(t(spark, d, "orders").select("o_orderkey"), sub, ["o_orderkey"], F.col("l_returnflag") == "R", F.col("l_quantity") > 45)


@query("empty_filter", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def empty_filter(spark, d):
    sub = t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return C.not_exists(t(spark, d, "customer").select("c_custkey"), sub, ["c_custkey"], F.col("o_orderstatus") == "O")


@query("filter_choices", "SELECT p_partkey FROM part WHERE p_size > 20 AND p_retailprice < 1000 AND p_brand IN ('Brand#1', 'Brand#2')")
def filter_choices(spark, d):
    return C.filter_choices(t(spark, d, "part"), F.col("p_size") > 20, F.col("p_retailprice") < 1000, S.is_one_of("p_brand", "Brand#1", "Brand#2")).select("p_partkey")


@query("count_choices", "SELECT count(*) AS n FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 10")
def count_choices(spark, d):
    return C.count_choices(t(spark, d, "lineitem"), F.col("l_discount") > 0.05, F.col("l_quantity") < 10)


@query("for_choices", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS value FROM part")
def for_choices(spark, d):
    return C.for_choices(t(spark, d, "part"), F.split("p_name", " "))


@query("choice_size", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1")
def choice_size(spark, d):
    return C.choice_size(t(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("singleton_values", "SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def singleton_values(spark, d):
    return C.singleton(t(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("largest_ties", "SELECT p_brand, p_partkey FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) = 1")
def largest_ties(spark, d):
    return C.largest(t(spark, d, "part"), F.col("p_size"), ["p_brand"]).select("p_brand", "p_partkey")


@query("smallest_ties", "SELECT o_orderkey FROM orders QUALIFY rank() OVER (ORDER BY o_orderdate) = 1")
def smallest_ties(spark, d):
    return C.smallest(t(spark, d, "orders"), F.col("o_orderdate")).select("o_orderkey")


@query("sorted_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sorted_top(spark, d):
    return C.top(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 25, F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query("total_order_strings", "SELECT p_name, dense_rank() OVER (ORDER BY octet_length(encode(p_name)), p_name) AS place FROM (SELECT DISTINCT p_name FROM part)")
def total_order_strings(spark, d):
    from pyspark.sql import Window

    names = t(spark, d, "part").select("p_name").distinct()
    return names.select("p_name", F.dense_rank().over(Window.orderBy(order.order_key(F.col("p_name"), "string"))).cast("long").alias("place"))


@query("elements", "SELECT DISTINCT unnest(embedding) AS element FROM embeddings")
def elements(spark, d):
    return C.elements(t(spark, d, "embeddings"), "embedding")


@query("choices_to_vector", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer GROUP BY 1")
def choices_to_vector(spark, d):
    return C.choices_to_vector(t(spark, d, "customer"), ["c_nationkey"], "c_mktsegment").select("c_nationkey", F.array_join("c_mktsegment", ",").alias("segments"))


@query("pick_n", None)
def pick_n(spark, d):
    return C.pick_n_by(t(spark, d, "part").select("p_brand", "p_partkey"), ["p_brand"], 3, seed=5)


@query("mp_call", "SELECT DISTINCT a.p_size * b.n_regionkey AS product FROM (SELECT DISTINCT p_size FROM part) a, (SELECT DISTINCT n_regionkey FROM nation) b")
def mp_call(spark, d):
    return C.mp_call(lambda a, b: a * b, "product", (t(spark, d, "part"), "p_size"), (t(spark, d, "nation"), "n_regionkey"))


_SETS = """WITH g AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS a, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS b FROM orders GROUP BY 1)
SELECT k, array_to_string(list_sort(a), ',') AS a, array_to_string(list_sort(coalesce(b, [])), ',') AS b, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS a_less_b,
 coalesce(len(b), 0) AS size_b, len(a) = 1 AS single, list_has_any(a, ['1-URGENT', '5-LOW']) AS overlaps,
 len(list_filter(a, lambda x: x > '2')) AS above, list_min(a) AS least, list_max(a) AS most FROM g"""


@query("set_columns", _SETS)
def set_columns(spark, d):
    g = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("sa"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("sb"))
    return g.select(
        "k", F.array_join(S.choice("sa", "sb"), ",").alias("a"), F.array_join(S.intersection("sb", "sa"), ",").alias("b"), F.array_join(S.difference("sa", "sb"), ",").alias("a_less_b"), S.choice_size("sb").alias("size_b"), S.is_singleton("sa").alias("single"),
        S.overlaps("sa", F.array(F.lit("1-URGENT"), F.lit("5-LOW"))).alias("overlaps"), S.count_choices("sa", lambda x: x > "2").alias("above"), F.get(S.smallest("sa"), F.lit(0)).alias("least"), F.get(S.largest("sa"), F.lit(0)).alias("most"),
    )


@query("set_try_singleton", "SELECT o_custkey AS k, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS single, count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'P') = 0 AS fell_back FROM orders GROUP BY 1")
def set_try_singleton(spark, d):
    g = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderstatus").alias("st"), F.collect_set(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("p"))
    tried = S.try_("p", F.array(F.lit("none")))
    return g.select("k", S.singleton("st").alias("single"), S.identical(tried, F.array(F.lit("none"))).alias("fell_back"))


# keyed tables


@query("increment_count", "SELECT event_type, count(*) AS value FROM events GROUP BY 1")
def increment_count(spark, d):
    return T.increment(t(spark, d, "events"), ["event_type"])


@query("increment_sum", "SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1")
def increment_sum(spark, d):
    return T.increment(t(spark, d, "lineitem"), ["l_suppkey"], F.col("l_quantity").cast("long"))


@query("increment_existing", "SELECT n_nationkey AS k, 10 + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS value FROM nation WHERE n_regionkey < 2")
def increment_existing(spark, d):
    table = t(spark, d, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("k"), F.lit(10).cast("long").alias("value"))
    return T.increment_existing(table, t(spark, d, "supplier").withColumnRenamed("s_nationkey", "k"), ["k"])


@query("table_add", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def table_add(spark, d):
    return T.add(t(spark, d, "lineitem"), ["l_partkey"], "l_suppkey")


@query("table_skim", "SELECT l_partkey, count(*) AS value FROM lineitem GROUP BY 1 HAVING count(*) >= 35")
def table_skim(spark, d):
    return T.skim(T.increment(t(spark, d, "lineitem"), ["l_partkey"]), 35)


@query("table_max", "SELECT user_id, count(*) AS value FROM events GROUP BY 1 QUALIFY rank() OVER (ORDER BY count(*) DESC) = 1")
def table_max(spark, d):
    return T.maximal(T.increment(t(spark, d, "events"), ["user_id"]))


@query("table_probe", "SELECT c_custkey AS k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS present FROM customer")
def table_probe(spark, d):
    return T.probe(t(spark, d, "orders").select(F.col("o_custkey").alias("k")), t(spark, d, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query("table_set", "SELECT n_nationkey AS key, CASE WHEN n_regionkey = 1 THEN 'new' ELSE n_name END AS value FROM nation")
def table_set(spark, d):
    n = t(spark, d, "nation")
    return T.set_(n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")), n.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("key"), F.lit("new").alias("value")), ["key"])


@query("table_zap", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def table_zap(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus")
    return T.zap(o, t(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("k")), ["k"]).select("o_orderkey", "o_orderstatus")


@query("table_alist", "SELECT n_name AS key, n_regionkey AS value FROM nation")
def table_alist(spark, d):
    return T.from_alist(T.to_alist(t(spark, d, "nation"), "n_name", "n_regionkey"), "alist")


@query("table_map", "SELECT DISTINCT event_type || ':' || CAST(user_id % 3 AS VARCHAR) AS result FROM events")
def table_map(spark, d):
    return T.map_(t(spark, d, "events"), F.concat_ws(":", "event_type", (F.col("user_id") % 3).cast("string")))


@query("table_statistics", "SELECT l_returnflag, count(l_quantity) AS n, sum(l_quantity) AS sum, sum(l_quantity * l_quantity) AS sumsq, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def table_statistics(spark, d):
    return T.statistics(t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity").withColumn("mean", F.round("mean", 6))


@query("hashset_accept", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def hashset_accept(spark, d):
    return T.accept(t(spark, d, "orders").select(F.col("o_custkey").alias("k")), t(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("hashset_filter", "SELECT DISTINCT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def hashset_filter(spark, d):
    return T.filter_(t(spark, d, "part").select(F.col("p_partkey").alias("k")), t(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("k")), ["k"])


@query("hashset_intern", "SELECT count(DISTINCT p_type) AS n FROM part")
def hashset_intern(spark, d):
    return T.intern(t(spark, d, "part"), "p_type").agg(F.countDistinct("hash").alias("n"))


@query("set_bounds", "SELECT o_custkey AS custkey, max(o_totalprice) > 400000 AS dear, min(o_totalprice) < 2000 AS cheap, bool_and(o_totalprice > 1000) AS every, bool_or(o_orderdate < DATE '1993-01-01') AS some FROM orders GROUP BY 1")
def set_bounds(spark, d):
    from ..functions import sequences as Q

    sets = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.collect_set("o_totalprice").alias("prices"), F.collect_set("o_orderdate").alias("days"))
    return sets.select(
        "custkey", S.any_greater("prices", F.lit(400000)).alias("dear"), S.any_less("prices", F.lit(2000)).alias("cheap"),
        Q.every(lambda x: x > 1000, "prices").alias("every"), Q.some(lambda x: x < F.lit("1993-01-01").cast("date"), "days").alias("some"),
    )


@query("proper_choices", "SELECT p_partkey, p_size % 3 <> p_size % 5 AS proper, p_size % 3 = 0 OR p_size % 5 = 0 AS satisfied FROM part")
def proper_choices(spark, d):
    pair = F.array(F.col("p_size") % 3, F.col("p_size") % 5)
    return t(spark, d, "part").select("p_partkey", S.is_proper_choice(pair).alias("proper"), F.exists(pair, lambda x: x == 0).alias("satisfied"))


@query("do_results", "SELECT conv_id, turn, length(text) AS n FROM conversations WHERE text IS NOT NULL")
def do_results(spark, d):
    def body(batches):
        for b in batches:
            yield b.assign(n=b["text"].map(len).astype("int64"))[["conv_id", "turn", "n"]]

    c = t(spark, d, "conversations").filter("text is not null")
    kind = dict(c.dtypes)
    return C.do_results(c.select("conv_id", "turn", "text"), body, f"conv_id {kind['conv_id']}, turn {kind['turn']}, n long")


@query("sorted_dearest", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40")
def sorted_dearest(spark, d):
    """A top list: the first 40 of all parts in sorted order."""
    return C.sorted_(t(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("p_retailprice").desc(), F.col("p_partkey")).limit(40)
