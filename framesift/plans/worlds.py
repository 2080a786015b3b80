"""Queries over times, URLs, markup, places, pools, records and change feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import markup as M
from ..functions import times as T
from ..functions import urls as U
from ..operators import pools
from ..scratch import shared_table
from ..sources import binary, records
from ..streaming import changes
from .catalog import query
from .sets import t


@query("calendar_fields", "SELECT event_id, year(ts) AS year, month(ts) - 1 AS monthnum, monthname(ts) AS month, day(ts) AS date, dayname(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def calendar_fields(spark, d):
    x = "ts"
    return t(spark, d, "events").select("event_id", T.get_year(x).alias("year"), T.get_monthnum(x).alias("monthnum"), T.get_month(x).alias("month"), T.get_date(x).alias("date"), T.get_day(x).alias("day"), T.get_hour(x).alias("hour"), T.get_minute(x).alias("minute"), T.get_second(x).alias("second"), T.iso_timestring(x).alias("iso"))


_DAY = "CASE WHEN h > 5 AND h < 12 THEN 'MORNING' END, CASE WHEN h > 12 AND h < 18 THEN 'AFTERNOON' END, CASE WHEN h > 16 AND h < 20 THEN 'EVENING' END, CASE WHEN h < 5 OR h > 20 THEN 'NIGHT' END"


@query("daytime_keys", f"SELECT event_id, k AS daytime FROM (SELECT event_id, unnest([{_DAY}]) AS k FROM (SELECT event_id, hour(ts) AS h FROM events)) WHERE k IS NOT NULL")
def daytime_keys(spark, d):
    return t(spark, d, "events").select("event_id", F.explode(T.get_daytime("ts")).alias("daytime"))


@query("season_keys", "SELECT o_orderkey, k AS season FROM (SELECT o_orderkey, unnest([CASE WHEN m > 5 AND m < 10 THEN 'SUMMER' END, CASE WHEN m > 2 AND m < 6 THEN 'SPRING' END, CASE WHEN m > 8 AND m < 12 THEN 'AUTUMN' END, CASE WHEN m < 4 OR m > 10 THEN 'WINTER' END]) AS k FROM (SELECT o_orderkey, month(o_orderdate) - 1 AS m FROM orders)) WHERE k IS NOT NULL")
def season_keys(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.explode(T.get_season("o_orderdate")).alias("season"))


_KEYS = f"""SELECT event_id, k AS timekey FROM (SELECT event_id, unnest([CAST(year(ts) AS VARCHAR), CASE WHEN m >= 5 AND m < 9 THEN 'SUMMER' END, CASE WHEN m >= 2 AND m <= 5 THEN 'SPRING' END,
 CASE WHEN m >= 8 AND m < 11 THEN 'AUTUMN' END, CASE WHEN m < 3 OR m > 10 THEN 'WINTER' END, upper(strftime(ts, '%b')), month(ts) || '/' || year(ts), day(ts) || CASE WHEN day(ts) IN (1, 21, 31) THEN 'ST' WHEN day(ts) IN (2, 22) THEN 'ND' WHEN day(ts) IN (3, 23) THEN 'RD' ELSE 'TH' END, ['SUN', 'MON', 'TUES', 'WED', 'THURS', 'FRI', 'SAT'][dayofweek(ts) + 1],
 'W' || ((dayofyear(ts) - 1) // 7 + 1), month(ts) || '/' || day(ts), {_DAY}, CASE WHEN h = 0 THEN 'MIDNIGHT' WHEN h = 12 THEN 'NOON' WHEN h < 12 THEN h || 'AM' ELSE (h - 12) || 'PM' END, h || ':' || strftime(ts, '%M')]) AS k FROM (SELECT event_id, ts, hour(ts) AS h, month(ts) - 1 AS m FROM events)) WHERE k IS NOT NULL"""


@query("time_keys", _KEYS)
def time_keys(spark, d):
    return t(spark, d, "events").select("event_id", F.explode(T.get_timekeys("ts")).alias("timekey"))


@query("time_search", "SELECT event_id FROM events WHERE day(ts) = 5 AND (month(ts) - 1 < 3 OR month(ts) - 1 > 10) AND hour(ts) > 5 AND hour(ts) < 12")
def time_search(spark, d):
    """A time query as clauses over time keys: every clause must meet the event's key set."""
    spec = T.parse_timespec(F.lit("2023-2025 winter 5"))
    clauses = F.concat(spec, F.array(F.array(F.lit("MORNING"))))
    e = t(spark, d, "events").select("event_id", T.get_timekeys("ts").alias("keys"), clauses.alias("clauses"))
    return e.filter(F.forall("clauses", lambda c: F.arrays_overlap(c, F.col("keys")))).select("event_id")


@query("dms_keys", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '+' END || lpad(CAST(floor(abs(c_acctbal) / 100) AS INTEGER)::VARCHAR, 3, '0') AS degrees FROM customer")
def dms_keys(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.substring(G.float_to_dms(F.col("c_acctbal") / 100), 1, 4).alias("degrees"))


@query("time_order", "SELECT a.event_id AS a, b.event_id AS b, a.ts < b.ts AS earlier, a.ts >= b.ts AS later, round(epoch_us(a.ts) / 1e6 - epoch_us(b.ts) / 1e6, 3) AS diff FROM events a JOIN events b ON a.event_id = b.event_id + 1")
def time_order(spark, d):
    e = t(spark, d, "events")
    a, b = e.select(F.col("event_id").alias("a"), F.col("ts").alias("x")), e.select((F.col("event_id") + 1).alias("a"), F.col("event_id").alias("b"), F.col("ts").alias("y"))
    return a.join(b, "a").select("a", "b", T.earlier("x", "y").alias("earlier"), T.later("x", "y").alias("later"), F.round(T.timestamp_diff("x", "y"), 3).alias("diff"))


@query("time_plus", "SELECT event_id, strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%S') AS later FROM events")
def time_plus(spark, d):
    return t(spark, d, "events").select("event_id", T.iso_timestring(T.timestamp_plus("ts", 90)).alias("later"))


@query("parse_iso", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, 'day' AS precision FROM orders")
def parse_iso(spark, d):
    p = T.parse_iso8601(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t(spark, d, "orders").select("o_orderkey", F.date_format(p["ts"], "yyyy-MM-dd").alias("day"), p["precision"].alias("precision"))


# URLs and markup


@query(
    "url_parts",
    r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^:/?#]*)', 1) AS host, regexp_extract(url, '://[^/]*(/[^?#]*/|/)', 1) AS dir,
 nullif(regexp_replace(regexp_extract(url, '/([^/?#]*)([?#].*)?$', 1), '\.[^.]*$', ''), '') AS name, nullif(regexp_extract(url, '\.([a-z]+)([?#].*)?$', 1), '') AS suffix, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM pages""",
)
def url_parts(spark, d):
    m = U.url_to_slotmap("url")
    return t(spark, d, "pages").select("page_id", *(m[f].alias(f) for f in ("scheme", "host", "dir", "name", "suffix", "query", "fragment")))


@query("url_domains", "SELECT page_id, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:], '.'))) AS domain FROM (SELECT page_id, string_split(regexp_extract(url, '://([^:/?#]*)', 1), '.') AS p FROM pages)")
def url_domains(spark, d):
    return t(spark, d, "pages").select("page_id", F.explode(U.get_domains(U.url_to_slotmap("url")["host"])).alias("domain"))


@query("url_normalize", r"SELECT page_id, regexp_extract(url, '^([a-z]+://[^:/?#]*)', 1) || ':80' || CASE WHEN regexp_matches(url, '://[^/]*/[a-z]+/[0-9]+/') THEN regexp_extract(url, '://[^/]*(/[a-z]+)/', 1) ELSE '' END || '/img/' || page_id || '.png' AS ref FROM pages")
def url_normalize(spark, d):
    return t(spark, d, "pages").select("page_id", U.normalize_url(F.concat(F.lit("../img/"), F.col("page_id").cast("string"), F.lit(".png")), F.col("url")).alias("ref"))


@query("html_get", "SELECT page_id, md5(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')) AS heading, len(regexp_extract_all(html, '<li>')) AS items FROM pages")
def html_get(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(F.get(M.html_get("html", "h1"), F.lit(0))).alias("heading"), F.size(M.html_get("html", "li")).alias("items"))


@query("html_links", "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, d):
    return t(spark, d, "pages").select("page_id", F.explode(M.html_attributes("html", "a", "href")).alias("href"))


@query("html_tree", None)
def html_tree(spark, d):
    return t(spark, d, "pages").select("page_id", F.length(M.parse_html("html")).alias("size"))


@query("xml_get", "SELECT n_nationkey, n_name AS name, 'n' || n_nationkey AS id, n_name AS deep FROM nation")
def xml_get(spark, d):
    xml = F.concat(F.lit("<nation id='n"), F.col("n_nationkey").cast("string"), F.lit("'><name>"), "n_name", F.lit("</name></nation>"))
    x = t(spark, d, "nation").select("n_nationkey", "n_name", xml.alias("xml"))
    return x.select("n_nationkey", M.xml_get("xml", "name")[0].alias("name"), M.xml_attribute("xml", "id").alias("id"), M.xml_getall("xml", "name")[0].alias("deep"))


@query("xml_round_trip", "SELECT n_nationkey, '<n><a>' || n_name || '</a></n>' AS xml FROM nation")
def xml_round_trip(spark, d):
    xml = F.concat(F.lit("<n>"), M.make_element("a", "n_name"), F.lit("</n>"))
    return t(spark, d, "nation").select("n_nationkey", M.unparse_markup(M.parse_xml(xml)).alias("xml"))


@query("read_mime", "SELECT c_custkey, c_name AS sender, c_mktsegment AS body FROM customer")
def read_mime(spark, d):
    mail = F.concat(F.lit("From: "), "c_name", F.lit("\nSubject: x\n\n"), "c_mktsegment")
    return t(spark, d, "customer").select("c_custkey", M.read_mime(mail).alias("m")).select("c_custkey", F.col("m")["from"].alias("sender"), F.col("m")["content"].alias("body"))


# places

_LAT, _LON = "(c_custkey % 120 - 60) * 1.0", "(c_custkey % 300 - 150) * 1.0"


@query(
    "geodistance",
    f"""WITH p AS (SELECT c_custkey, radians({_LAT}) AS a, radians({_LON}) AS b, radians(42.36) AS c, radians(-71.06) AS d FROM customer)
 SELECT c_custkey, round(2 * asin(sqrt(least(pow(sin((a - c) / 2), 2) + cos(a) * cos(c) * pow(sin((b - d) / 2), 2), 1.0))) * 1852 * 180 * 60 / pi(), 1) AS metres FROM p""",
)
def geodistance(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.round(G.geodistance(F.expr(f"cast({_LAT} as double)"), F.expr(f"cast({_LON} as double)"), 42.36, -71.06), 1).alias("metres"))


@query(
    "geodirection",
    f"""WITH p AS (SELECT c_custkey, radians({_LAT}) AS a, radians({_LON}) AS b, radians(42.36) AS c, radians(-71.06) AS d FROM customer),
 q AS (SELECT c_custkey, degrees(atan2(sin(d - b) * cos(c), cos(a) * sin(c) - sin(a) * cos(c) * cos(d - b))) AS x FROM p) SELECT c_custkey, round(CASE WHEN x < 0 THEN x + 360 ELSE x END, 6) AS bearing FROM q""",
)
def geodirection(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.round(G.geodirection(F.expr(f"cast({_LAT} as double)"), F.expr(f"cast({_LON} as double)"), 42.36, -71.06), 6).alias("bearing"))


@query("geo_range_join", f"SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON {_LAT} BETWEEN (s_suppkey % 50) - 1.5 AND (s_suppkey % 50) + 1.5")
def geo_range_join(spark, d):
    """A range join as a join on equal quantised keys and an exact test, made between places and not between rows.

    The rows of one place come in lists of bounded length. Pairs of lists are dealt over the tasks before they are
    expanded, so a crowded place isn't one task's work. Every pair of rows arises once, for a place has one cell.
    """
    c = _lists(t(spark, d, "customer").select("c_custkey", F.expr(f"cast({_LAT} as double)").alias("lat")), "lat", "c_custkey", "c")
    c = c.withColumn("cell", F.explode(G.latrange("lat", 1.0)))
    s = _lists(t(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50).cast("double").alias("mid")), "mid", "s_suppkey", "s")
    s = s.withColumn("cell", F.explode(G.span_keys(F.col("mid") - 2, F.col("mid") + 2, 1.0)))
    near = s.join(c, "cell").filter((F.col("lat") >= F.col("mid") - 1.5) & (F.col("lat") <= F.col("mid") + 1.5))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = near.select("mid", "lat", "s", "c", "ss", "cs").repartition(tasks, "mid", "lat", "s", "c")
    return dealt.select(F.explode("ss").alias("s_suppkey"), "cs").select("s_suppkey", F.explode("cs").alias("c_custkey"))


def _lists(rows, place, oid, name):
    """Ids by place and stretch of 16,384 rows, as ``name`` (the stretch) and ``name`` + s (the list): no list is longer than a stretch."""
    rows = rows.withColumn(name, F.shiftright(F.monotonically_increasing_id(), 14))
    return rows.groupBy(place, name).agg(F.collect_list(oid).alias(f"{name}s"))


# pools


@query("get_pool", "SELECT o_orderkey AS oid, CASE WHEN o_orderkey < 1000 THEN 'a' WHEN o_orderkey < 5000 THEN 'b' ELSE 'c' END AS label FROM orders WHERE o_orderkey < 9000")
def get_pool(spark, d):
    return pools.get_pool(t(spark, d, "orders").select(F.col("o_orderkey").alias("oid")), pools.catalog(spark, [(0, 1000, "a"), (1000, 4000, "b"), (5000, 4000, "c")]), bucket=1024)


@query("pool_statistics", "SELECT CAST(min(p_partkey) AS BIGINT) AS base, count(*) AS load, CAST(1000000 AS BIGINT) AS capacity, 1000000 - count(*) AS freespace FROM part")
def pool_statistics(spark, d):
    return pools.statistics(t(spark, d, "part").select(F.col("p_partkey").alias("oid")), 1_000_000)


@query("pool_diff", "SELECT c_custkey AS oid, CASE WHEN c_custkey % 10 = 0 THEN 'dropped' WHEN c_custkey % 10 = 1 THEN 'modified' END AS change FROM customer WHERE c_custkey % 10 < 2 UNION ALL SELECT -1 - c_custkey, 'added' FROM customer WHERE c_custkey < 5")
def pool_diff(spark, d):
    old = t(spark, d, "customer").select(F.col("c_custkey").alias("oid"), F.col("c_name").alias("value"))
    new = old.filter("oid % 10 <> 0").withColumn("value", F.when(F.col("oid") % 10 == 1, F.lower("value")).otherwise(F.col("value")))
    return pools.diff(old, new.unionByName(old.filter("oid < 5").withColumn("oid", -1 - F.col("oid"))))


@query("allocate_oids", "SELECT count(*) AS n, CAST(500 AS BIGINT) AS first, 499 + count(*) AS last, count(*) AS different FROM nation")
def allocate_oids(spark, d):
    got = pools.allocate(t(spark, d, "nation").repartition(4, "n_nationkey"), 500)
    return got.agg(F.count("*").alias("n"), F.min("oid").alias("first"), F.max("oid").alias("last"), F.countDistinct("oid").alias("different"))


@query("oid_parts", "SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS hi, o_orderkey AS lo FROM orders")
def oid_parts(spark, d):
    oid = pools.make_oid(F.col("o_custkey"), F.col("o_orderkey"))
    return t(spark, d, "orders").select("o_orderkey", pools.oid_high(oid).alias("hi"), pools.oid_low(oid).alias("lo"))


@query("oid_values", "SELECT o_orderkey AS oid, o_orderstatus AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def oid_values(spark, d):
    pool = t(spark, d, "orders").select(F.col("o_orderkey").alias("oid"), F.col("o_orderstatus").alias("value"))
    return pools.oid_value(pool, t(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_orderkey").alias("oid")))


@query("index_store", "SELECT 'p_type' AS slot, p_type AS value, p_partkey AS oid FROM part")
def index_store(spark, d):
    """An index written as a store partitioned by slot, and opened again."""
    from ..operators.index import Index
    from .frames import parts

    path = changes.scratch_target(spark)
    Index.index_frames(parts(spark, d), ["p_type", "p_size"]).write(path)
    return Index.open(spark, path).postings.filter("slot = 'p_type'")


# records and values


@query("record_stream", "SELECT doc_id, count(*) AS records FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS r FROM documents) WHERE r <> '' GROUP BY 1")
def record_stream(spark, d):
    return records.records(t(spark, d, "documents"), F.col("text"), "\n", ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("records"))


@query("packet_round_trip", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def packet_round_trip(spark, d):
    back = binary.read_packet(binary.write_packet(F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit("]"))))
    return t(spark, d, "events").select("event_id", F.get_json_object(back, "$[0]").alias("k"))


# change feeds


def _log(spark, d):
    return t(spark, d, "events").select(F.col("event_id").alias("stamp"), F.col("user_id").alias("key"), "event_type")


@query("changes_since", "SELECT DISTINCT user_id AS key FROM events WHERE event_id > 9800")
def changes_since(spark, d):
    return changes.changes_since(_log(spark, d), 9800)


@query("sync_stamp", "SELECT min(event_id) > 51 AS refresh, max(event_id) AS syncstamp FROM (SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 1000)")
def sync_stamp(spark, d):
    return changes.needs_refresh(changes.ring(_log(spark, d), 1000), 50)


@query(
    "apply_changes",
    "SELECT key, value FROM (SELECT user_id AS key, event_type AS value, value > 50 AS added, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND added UNION SELECT user_id, 'base' FROM events",
)
def apply_changes(spark, d):
    e = t(spark, d, "events")
    log = e.select(F.col("event_id").alias("stamp"), F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.when(F.col("value") > 50, "add").otherwise("drop").alias("op"))
    return changes.apply_changes(e.select(F.col("user_id").alias("key"), F.lit("base").alias("value")).distinct(), log)


@query("change_feed", "SELECT user_id AS key, count(*) AS n, max(event_id) AS stamp FROM events GROUP BY 1")
def change_feed(spark, d):
    """The table as a stream of files, drained by a streaming query."""
    source = changes.scratch_target(spark)
    log = _log(spark, d).select("stamp", "key")
    log.repartition(4).write.parquet(source)
    return changes.follow(spark, source, log.schema, "key", changes.scratch_target(spark))
