"""Queries over frames, slots, closures, indices and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import closures, search
from ..operators.frames import FrameStore, record_to_frame
from ..operators.index import Index
from .catalog import query
from .sets import t

PART_SLOTS = ["p_brand", "p_type", "p_size", "p_name"]


def parts(spark, d) -> FrameStore:
    return FrameStore.from_wide(t(spark, d, "part"), "p_partkey", PART_SLOTS)


def lines(spark, d, slots) -> FrameStore:
    return FrameStore.from_wide(t(spark, d, "lineitem"), F.col("l_orderkey") * 8 + F.col("l_linenumber"), slots)


def graph(spark, d) -> FrameStore:
    """Customers, nations, regions as frames with text ids, linked by slots."""
    link = lambda name, a, p, b, q, slot: t(spark, d, name).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("oid"), F.lit(slot).alias("slot"), F.concat(F.lit(q), F.col(b).cast("string")).alias("value"))
    rows = [link("customer", "c_custkey", "c", "c_nationkey", "n", "partof"), link("supplier", "s_suppkey", "s", "s_nationkey", "n", "partof"), link("nation", "n_nationkey", "n", "n_regionkey", "r", "partof")]
    rows.append(t(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("oid"), F.lit("label").alias("slot"), F.col("r_name").alias("value")))
    rows.append(t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("oid"), F.lit("label").alias("slot"), F.col("n_name").alias("value")))
    return FrameStore(reduce(lambda a, b: a.unionByName(b), rows))


_GRAPH = """g AS (SELECT 'c' || c_custkey AS oid, 'partof' AS slot, 'n' || c_nationkey AS value FROM customer
 UNION ALL SELECT 's' || s_suppkey, 'partof', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'partof', 'r' || n_regionkey FROM nation
 UNION ALL SELECT 'r' || r_regionkey, 'label', r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'label', n_name FROM nation)"""
_PARTS = """s AS (SELECT p_partkey AS oid, 'p_brand' AS slot, p_brand AS value FROM part UNION SELECT p_partkey, 'p_type', p_type FROM part
 UNION SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part UNION SELECT p_partkey, 'p_name', p_name FROM part)"""


@query("frame_slots", f"WITH {_PARTS} SELECT slot, count(*) AS frames, count(DISTINCT value) AS vals FROM s GROUP BY 1")
def frame_slots(spark, d):
    return parts(spark, d).slots.distinct().groupBy("slot").agg(F.count("*").alias("frames"), F.countDistinct("value").alias("vals"))


@query("count_slots", f"WITH {_PARTS} SELECT oid, count(DISTINCT slot) AS n FROM s GROUP BY 1")
def count_slots(spark, d):
    return parts(spark, d).count_slots()


@query("get_slot", "SELECT p_partkey AS oid, p_brand AS value FROM part")
def get_slot(spark, d):
    return parts(spark, d).get("p_brand")


@query("multi_slot_get", f"WITH {_PARTS} SELECT DISTINCT oid, value FROM s WHERE slot IN ('p_brand', 'p_type')")
def multi_slot_get(spark, d):
    return parts(spark, d).multi_get(["p_brand", "p_type"])


@query("get_chain", f"WITH {_GRAPH} SELECT a.oid, c.value FROM g a JOIN g b ON a.value = b.oid AND b.slot = 'partof' JOIN g c ON b.value = c.oid AND c.slot = 'label' WHERE a.slot = 'partof' AND a.oid LIKE 'c%'")
def get_chain(spark, d):
    g = graph(spark, d)
    return g.follow(t(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("oid")), "partof", "partof", "label")


@query("test_frames", f"WITH {_PARTS} SELECT DISTINCT oid FROM s WHERE slot IN ('p_brand', 'p_type') AND value IN ('Brand#3', 'PROMO')")
def test_frames(spark, d):
    return parts(spark, d).test(["p_brand", "p_type"], ["Brand#3", "PROMO"])


@query("pick_frames", "SELECT p_partkey AS oid FROM part WHERE p_brand IN ('Brand#1', 'Brand#5') AND p_type = 'ECONOMY' AND p_size IN (1, 2, 3, 4, 5, 6, 7, 8)")
def pick_frames(spark, d):
    return parts(spark, d).pick(("p_brand", ["Brand#1", "Brand#5"]), ("p_type", ["ECONOMY"]), ("p_size", list(range(1, 9))))


@query("do_slots", f"WITH {_GRAPH} SELECT oid, slot, array_to_string(list_sort(list(DISTINCT value)), ',') AS vals FROM g GROUP BY 1, 2")
def do_slots(spark, d):
    return graph(spark, d).do_slots().select("oid", "slot", F.array_join("values", ",").alias("vals"))


@query("with_slots", "SELECT 'n' || n_nationkey AS oid, 'r' || n_regionkey AS partof, n_name AS label FROM nation")
def with_slots(spark, d):
    return graph(spark, d).with_slots("partof", "label").filter("oid like 'n%'").select("oid", F.array_join("partof", ",").alias("partof"), F.array_join("label", ",").alias("label"))


@query("slot_add_drop", f"WITH {_GRAPH} SELECT DISTINCT oid, slot, value FROM g WHERE NOT (slot = 'label' AND oid LIKE 'n%') UNION SELECT 'r' || r_regionkey, 'tag', 'top' FROM region")
def slot_add_drop(spark, d):
    g = graph(spark, d)
    tops = t(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("oid"), F.lit("tag").alias("slot"), F.lit("top").alias("value"))
    return g.add(tops).drop(g.slots.filter("slot = 'label' and oid like 'n%'")).slots


@query("slot_set_zap", f"WITH {_GRAPH} SELECT DISTINCT oid, slot, CASE WHEN slot = 'label' THEN lower(value) ELSE value END AS value FROM g WHERE NOT (slot = 'partof' AND oid LIKE 's%')")
def slot_set_zap(spark, d):
    g = graph(spark, d)
    low = g.set_(g.slots.filter("slot = 'label'").withColumn("value", F.lower("value")))
    return low.zap(g.slots.filter("oid like 's%'").select("oid", F.lit("partof").alias("slot"))).slots.distinct()


@query("assert_validated", f"WITH {_PARTS} SELECT * FROM s UNION SELECT p_partkey, 'weight', CAST(p_size * 10 AS VARCHAR) FROM part WHERE p_size * 10 < 200")
def assert_validated(spark, d):
    new = t(spark, d, "part").select(F.col("p_partkey").alias("oid"), F.lit("weight").alias("slot"), (F.col("p_size") * 10).cast("string").alias("value"))
    return parts(spark, d).assert_(new, {"weight": F.col("value").cast("int") < 200}).slots


@query("cachable_get", "SELECT p_partkey AS oid, CASE WHEN p_size < 10 THEN p_name ELSE p_type END AS value FROM part")
def cachable_get(spark, d):
    base = t(spark, d, "part")
    stored = base.filter("p_size < 10").select(F.col("p_partkey").alias("oid"), F.lit("title").alias("slot"), F.col("p_name").alias("value"))
    derive = lambda s: base.select(F.col("p_partkey").alias("oid"), F.col("p_type").alias("value"))
    return FrameStore(stored, {"title": derive}).cachable_get("title")


@query("inverse_get", f"WITH {_GRAPH} SELECT DISTINCT value AS oid, oid AS value FROM g WHERE slot = 'partof' AND oid LIKE 'n%'")
def inverse_get(spark, d):
    g = graph(spark, d)
    return g.inverse_get("parts", "partof").filter("value like 'n%'")


@query("assoc_get", "SELECT DISTINCT user_id AS oid, CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) AS value FROM events WHERE event_type = 'click'")
def assoc_get(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("oid"), F.lit("did").alias("slot"), F.concat_ws("=", "event_type", F.floor("value").cast("int").cast("string")).alias("value"))
    return FrameStore(rows).assoc_get("did", "click")


@query("lookup_frame", "SELECT 'n' || n_nationkey AS oid FROM nation WHERE n_name = 'NATION_7'")
def lookup_frame(spark, d):
    return graph(spark, d).lookup_frame("NATION_7", "label")


@query("copy_frames", f"WITH {_GRAPH} SELECT DISTINCT oid, slot, value FROM g UNION SELECT 'x' || oid, slot, value FROM g WHERE oid LIKE 'r%'")
def copy_frames(spark, d):
    g = graph(spark, d)
    return g.copy_frames(g.slots.filter("oid like 'r%'").select("oid", F.concat(F.lit("x"), "oid").alias("new_oid")).distinct()).slots


@query("export_import", f"WITH {_GRAPH} SELECT DISTINCT oid, slot, value FROM g WHERE oid LIKE 'n%' OR oid LIKE 'r%'")
def export_import(spark, d):
    g = graph(spark, d)
    return FrameStore.import_frames(FrameStore(g.slots.filter("oid like 'n%' or oid like 'r%'")).export_frames()).slots


@query("record_to_frame", "SELECT event_id AS oid, event_type AS kind, CASE WHEN value > 50 THEN round(value, 2) END AS amount FROM events")
def record_to_frame_query(spark, d):
    rec = F.array("event_type", F.when(F.col("value") > 50, F.round("value", 2).cast("string")).otherwise(F.lit("")))
    return t(spark, d, "events").select(*record_to_frame(F.col("event_id"), rec, ["kind", "amount"], {"amount": "double"}))


# closures

_CYCLE = """e AS (SELECT DISTINCT c_nationkey AS src, CAST(c_custkey % 25 AS INTEGER) AS dst FROM customer)"""


def _cycle(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 25).cast("int").alias("dst")).distinct()


@query("closure", f"WITH RECURSIVE {_CYCLE}, w AS (SELECT n_nationkey AS root, n_nationkey AS node FROM nation UNION SELECT w.root, e.dst FROM w JOIN e ON w.node = e.src) SELECT * FROM w")
def closure(spark, d):
    return closures.get_star(t(spark, d, "nation").select(F.col("n_nationkey").alias("root")), _cycle(spark, d))


@query("value_path", f"WITH RECURSIVE {_CYCLE}, w AS (SELECT n_nationkey AS root, n_nationkey AS node FROM nation UNION SELECT w.root, e.dst FROM w JOIN e ON w.node = e.src) SELECT n_nationkey AS a, n_regionkey AS b, EXISTS (SELECT 1 FROM w WHERE root = n_nationkey AND node = n_regionkey) AS path FROM nation")
def value_path(spark, d):
    return closures.value_path(t(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b")), _cycle(spark, d))


@query("inherit_values", f"WITH RECURSIVE {_GRAPH}, w AS (SELECT DISTINCT oid AS root, oid AS node FROM g WHERE oid LIKE 's%' UNION SELECT w.root, g.value FROM w JOIN g ON w.node = g.oid AND g.slot = 'partof') SELECT DISTINCT root, value FROM w JOIN g ON w.node = g.oid AND g.slot = 'label'")
def inherit_values(spark, d):
    g = graph(spark, d)
    return g.inherit_values(g.slots.filter("oid like 's%'").select(F.col("oid").alias("root")).distinct(), "label", "partof")


# indices and search


@query("find_frames_and_or", "SELECT l_orderkey * 8 + l_linenumber AS oid FROM lineitem WHERE l_returnflag IN ('R', 'A') INTERSECT SELECT l_orderkey * 8 + l_linenumber FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT l_orderkey * 8 + l_linenumber FROM lineitem WHERE l_quantity = 10")
def find_frames_and_or(spark, d):
    ix = Index(lines(spark, d, ["l_returnflag", "l_linestatus", "l_quantity"]).slots)
    return search.find_frames(ix, ("l_returnflag", ["R", "A"]), ("l_linestatus", ["F"]), ("l_quantity", ["10.0"]))


@query("index_get", "SELECT p_partkey AS oid FROM part WHERE p_brand = 'Brand#4' OR p_type = 'SMALL'")
def index_get(spark, d):
    return Index.index_frames(parts(spark, d)).get(("p_brand", "Brand#4"), ("p_type", "SMALL"))


@query("index_get_size", "SELECT 'o_orderpriority' AS slot, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2")
def index_get_size(spark, d):
    return Index.index_frames(FrameStore.from_wide(t(spark, d, "orders"), "o_orderkey", ["o_orderpriority", "o_orderstatus"]), ["o_orderpriority"]).get_size()


@query("index_keys", f"WITH {_PARTS} SELECT DISTINCT slot, value FROM s WHERE slot <> 'p_name'")
def index_keys(spark, d):
    return Index.index_frames(parts(spark, d), stop_slots=("p_name",)).keys()


@query("index_expanders", "SELECT DISTINCT 'p_name' AS slot, unnest(string_split(p_name, ' ')) AS value, p_partkey AS oid FROM part")
def index_expanders(spark, d):
    return Index.index_frames(parts(spark, d), ["p_name"], expanders={"p_name": lambda v: F.split(v, " ")}).postings


@query("index_add_drop", "SELECT 'p_type' AS slot, p_type AS value, p_partkey AS oid FROM part WHERE p_size <= 45 UNION SELECT 'big', 'yes', p_partkey FROM part WHERE p_size > 45")
def index_add_drop(spark, d):
    p = t(spark, d, "part")
    ix = Index.index_frames(parts(spark, d), ["p_type"])
    big = p.filter("p_size > 45")
    ix = ix.drop(big.select(F.lit("p_type").alias("slot"), F.col("p_type").alias("value"), F.col("p_partkey").alias("oid")))
    key = spark.createDataFrame([("big", "yes")], "slot string, value string")
    return ix.add(key, big.select(F.col("p_partkey").alias("oid"))).postings


@query("index_zap", "SELECT 'p_type' AS slot, p_type AS value, p_partkey AS oid FROM part WHERE p_type <> 'PROMO'")
def index_zap(spark, d):
    return Index.index_frames(parts(spark, d), ["p_type"]).zap(spark.createDataFrame([("p_type", "PROMO")], "slot string, value string")).postings


@query("posting_histogram", "SELECT n AS values, count(*) AS keys FROM (SELECT l_partkey, count(DISTINCT l_orderkey * 8 + l_linenumber) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def posting_histogram(spark, d):
    return Index.index_frames(lines(spark, d, ["l_partkey"])).histogram()


@query("index_threshold", "SELECT 'l_suppkey' AS slot, CAST(l_suppkey AS VARCHAR) AS value, count(DISTINCT l_orderkey * 8 + l_linenumber) AS n FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey * 8 + l_linenumber) > 600")
def index_threshold(spark, d):
    return Index.index_frames(lines(spark, d, ["l_suppkey"])).above(600)


@query("compound_index", "SELECT slot, value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'p_brand' AS slot, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part WHERE p_size < 5 GROUP BY 2) GROUP BY 1, 2")
def compound_index(spark, d):
    a = Index.index_frames(parts(spark, d), ["p_brand"])
    b = Index.index_frames(FrameStore.from_wide(t(spark, d, "part").filter("p_size < 5"), "p_partkey", ["p_brand"]))
    return Index.compound(a, b).get_size()


@query("scores", "SELECT p_partkey AS oid, CAST(p_brand = 'Brand#7' AS BIGINT) + CAST(p_type = 'MEDIUM' AS BIGINT) + CAST(p_size IN (10, 11, 12) AS BIGINT) AS score FROM part WHERE p_brand = 'Brand#7' OR p_type = 'MEDIUM' OR p_size IN (10, 11, 12)")
def scores(spark, d):
    return search.scores(Index.index_frames(parts(spark, d)), ("p_brand", ["Brand#7"]), ("p_type", ["MEDIUM"]), ("p_size", [10, 11, 12]))


@query("best", "WITH x AS (SELECT p_partkey AS oid, CAST(p_brand = 'Brand#7' AS BIGINT) + CAST(p_type = 'MEDIUM' AS BIGINT) + CAST(p_size IN (10, 11, 12) AS BIGINT) AS score FROM part) SELECT * FROM x WHERE score = (SELECT max(score) FROM x)")
def best(spark, d):
    return search.best(search.scores(Index.index_frames(parts(spark, d)), ("p_brand", ["Brand#7"]), ("p_type", ["MEDIUM"]), ("p_size", [10, 11, 12])))


_SIM = f"""WITH {_PARTS}, k AS (SELECT oid AS sample, slot, value FROM s WHERE oid IN (3, 8)),
 x AS (SELECT oid, count(DISTINCT (sample, slot)) AS score FROM s JOIN k USING (slot, value) GROUP BY 1)"""


def _samples(spark):
    return spark.createDataFrame([(3,), (8,)], "oid long")


@query("scores_from_samples", f"{_SIM} SELECT oid, score FROM x")
def scores_from_samples(spark, d):
    return search.scores_from_samples(Index.index_frames(parts(spark, d)), _samples(spark))


@query("best_from_samples", f"{_SIM}, y AS (SELECT oid, CASE WHEN oid IN (3, 8) THEN 0 ELSE score END AS score FROM x) SELECT oid, score FROM y WHERE score = (SELECT max(score) FROM y)")
def best_from_samples(spark, d):
    return search.best_from_samples(Index.index_frames(parts(spark, d)), _samples(spark))


@query("find_similar", f"WITH {_PARTS}, k AS (SELECT oid AS sample, slot, value FROM s WHERE oid = 3 AND slot IN ('p_brand', 'p_type')) SELECT oid FROM s JOIN k USING (slot, value) GROUP BY 1 HAVING count(DISTINCT (sample, slot)) = (SELECT count(DISTINCT (sample, slot)) FROM k)")
def find_similar(spark, d):
    return search.find_similar(Index.index_frames(parts(spark, d)), spark.createDataFrame([(3,)], "oid long"), ["p_brand", "p_type"])


@query(
    "similar_scored",
    f"""WITH {_PARTS}, k AS (SELECT oid AS sample, slot, value FROM s WHERE oid = 3), c AS (SELECT DISTINCT oid FROM s JOIN k USING (slot, value) WHERE slot = 'p_type'),
 x AS (SELECT oid, CASE WHEN oid = 3 THEN 0 ELSE count(DISTINCT (sample, slot)) END AS score FROM s JOIN k USING (slot, value) WHERE oid IN (SELECT oid FROM c) GROUP BY 1)
 SELECT oid, score FROM x WHERE score = (SELECT max(score) FROM x)""",
)
def similar_scored(spark, d):
    return search.similar_scored(Index.index_frames(parts(spark, d)), spark.createDataFrame([(3,)], "oid long"), ["p_type"])


@query("assoc_test", "SELECT DISTINCT user_id AS oid FROM events WHERE event_type = 'error' AND floor(value) = 6")
def assoc_test(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("oid"), F.lit("did").alias("slot"), F.concat_ws("=", "event_type", F.floor("value").cast("int").cast("string")).alias("value"))
    return FrameStore(rows).assoc_test("did", "error", "6")


@query("assoc_drop", "SELECT DISTINCT user_id AS oid, event_type AS value FROM events WHERE event_type <> 'view'")
def assoc_drop(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("oid"), F.lit("did").alias("slot"), F.concat_ws("=", "event_type", F.floor("value").cast("string")).alias("value"))
    store = FrameStore(rows)
    return store.paired_drop("did", rows.select("oid", F.lit("view").alias("value"))).car_get("did")


@query("modify_frames", f"WITH {_PARTS} SELECT oid, slot, CASE WHEN slot = 'p_name' AND oid < 100 THEN upper(value) ELSE value END AS value FROM s")
def modify_frames(spark, d):
    return parts(spark, d).modify_frames(t(spark, d, "part").filter("p_partkey < 100").select(F.col("p_partkey").alias("oid")), "p_name", F.upper("value")).slots


@query("make_frames", "SELECT n_nationkey AS oid, k AS slot, v AS value FROM nation, (VALUES ('kind', 'nation'), ('state', 'new')) x(k, v)")
def make_frames(spark, d):
    empty = FrameStore(spark.createDataFrame([], "oid int, slot string, value string"))
    return empty.make_frames(t(spark, d, "nation").select(F.col("n_nationkey").alias("oid")), kind="nation", state="new").slots


@query("adjunct_get", "SELECT p_partkey AS oid, CAST(count(l_orderkey) AS VARCHAR) AS value FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def adjunct_get(spark, d):
    sales = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("oid")).agg(F.count("*").cast("string").alias("value"))
    return parts(spark, d).with_adjunct("sales", sales).get("sales")


@query("search_all", "SELECT p_partkey AS oid FROM part WHERE p_brand = 'Brand#2' AND p_size < 10 UNION SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_size >= 40")
def search_all(spark, d):
    p = t(spark, d, "part")
    a, b = (Index.index_frames(FrameStore.from_wide(x, "p_partkey", ["p_brand", "p_type"])) for x in (p.filter("p_size < 10"), p.filter("p_size >= 40")))
    return search.search_all([a, b], ("p_brand", ["Brand#2"]))


@query("use_frames", "SELECT 'n' || n_nationkey AS oid, 'label' AS slot, n_name AS value FROM nation UNION ALL SELECT 'new0', 'label', 'ATLANTIS'")
def use_frames(spark, d):
    g = FrameStore(graph(spark, d).slots.filter("slot = 'label' and oid like 'n%'"))
    return g.use_frames(spark.createDataFrame([("new0", "ATLANTIS"), ("new1", "NATION_3")], "oid string, name string"), "label").slots


@query("nation_taxonomy", f"WITH RECURSIVE {_GRAPH}, w AS (SELECT oid AS root, oid AS node FROM g WHERE oid LIKE 'c%' UNION SELECT w.root, g.value FROM w JOIN g ON w.node = g.oid AND g.slot = 'partof') SELECT DISTINCT root FROM w JOIN g ON node = oid WHERE slot = 'label' AND value = 'ASIA'")
def nation_taxonomy(spark, d):
    """Frames that inherit a value through links: the class restriction of a concept search."""
    g = graph(spark, d)
    roots = g.slots.filter("oid like 'c%'").select(F.col("oid").alias("root")).distinct()
    return closures.inherits_value(roots, g.edges("partof"), g.get("label").select("oid", "value"), "ASIA")


@query("retract", f"WITH {_GRAPH} SELECT * FROM g WHERE NOT (slot = 'partof' AND value = 'n0') AND NOT (slot = 'label' AND oid = 'n0')")
def retract(spark, d):
    g = graph(spark, d)
    return g.retract(g.slots.filter("slot = 'partof' and value = 'n0'"), lambda rows: g.slots.join(rows.select(F.col("value").alias("oid")).distinct(), "oid", "left_semi").filter("slot = 'label'")).slots


@query("multi_add", "SELECT p_partkey AS oid, 'kind' AS slot, 'ODD' AS value FROM part WHERE p_size % 2 = 1")
def multi_add(spark, d):
    """Values that a sub-slot holds already are not added to the primary slot."""
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("oid"), F.when(F.col("p_size") % 2 == 1, F.lit("ODD")).otherwise(F.col("p_type")).alias("value"))
    return parts(spark, d).multi_add(rows, "kind", ["p_type", "p_brand"]).slots.filter("slot = 'kind'")


@query("multi_drop", f"WITH {_PARTS} SELECT s.* FROM s JOIN part ON oid = p_partkey WHERE NOT (slot IN ('p_type', 'p_brand') AND p_size > 25 AND value IN (p_type, p_brand))")
def multi_drop(spark, d):
    gone = t(spark, d, "part").filter("p_size > 25")
    rows = gone.select(F.col("p_partkey").alias("oid"), F.explode(F.array("p_type", "p_brand")).alias("value"))
    return parts(spark, d).multi_drop(rows, ["p_type", "p_brand"]).slots


def _twice(spark, d):
    store = parts(spark, d)
    return FrameStore(store.slots, {"twice": lambda s: s.pget("p_size").select("oid", (F.col("value").cast("int") * 2).cast("string").alias("value"))})


@query("cached_get", "SELECT p_partkey AS oid, 'twice' AS slot, CAST(2 * p_size AS VARCHAR) AS value FROM part")
def cached_get(spark, d):
    return _twice(spark, d).cached_get("twice").slots.filter("slot = 'twice'")


@query("cached_test", "SELECT p_partkey AS oid FROM part WHERE p_size = 7")
def cached_test(spark, d):
    return _twice(spark, d).cached_test("twice", "14")


def _properties(spark, d):
    """Entries "type=user=value" of events: pairs whose second half holds the sign as well."""
    e = t(spark, d, "events")
    return FrameStore(e.select(F.col("event_id").alias("oid"), F.lit("props").alias("slot"), F.concat_ws("=", "event_type", F.col("user_id").cast("string"), F.lit("x")).alias("value")))


@query("assoc_get_whole", "SELECT event_id AS oid, user_id || '=x' AS value FROM events WHERE event_type = 'click'")
def assoc_get_whole(spark, d):
    return _properties(spark, d).assoc_get("props", "click")


@query("assoc_add", "SELECT event_id AS oid, 'new=1' AS value FROM events WHERE event_type = 'click'")
def assoc_add(spark, d):
    store = _properties(spark, d)
    return store.assoc_add("props", "more", store.assoc_get("props", "click").select("oid", F.lit("new=1").alias("value"))).assoc_get("props", "more")


@query("assoc_drop_whole", "SELECT event_id AS oid FROM events WHERE event_type = 'click' AND user_id % 2 = 0")
def assoc_drop_whole(spark, d):
    store = _properties(spark, d)
    odd = t(spark, d, "events").filter("user_id % 2 = 1").select(F.col("event_id").alias("oid"), F.concat(F.col("user_id").cast("string"), F.lit("=x")).alias("value"))
    return store.assoc_drop("props", "click", odd).assoc_get("props", "click").select("oid")


@query("paired_test", "SELECT event_id AS oid FROM events WHERE event_type = 'click'")
def paired_test(spark, d):
    return _properties(spark, d).paired_test("props", "click")


@query("inverse_test", "SELECT 'n' || c_nationkey AS oid FROM customer WHERE c_custkey = 5")
def inverse_test(spark, d):
    return graph(spark, d).inverse_test("contains", "partof", "c5")
