"""Golden values: sets, orders, searches, closures and scalars on small inputs."""

import pytest
from compare import rows
from pyspark.sql import functions as F

from framesift.functions import markup, numbers, order, patterns, sequences, sets, strings, text, times, urls
from framesift.operators import choices, closures, pools, search, tables
from framesift.operators.frames import FrameStore
from framesift.operators.index import Index
from framesift.sources import binary, records
from framesift.streaming import changes


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def ints(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "x long")


def col(df, name=None):
    return sorted(r[0] if name is None else r[name] for r in df.collect())


def test_set_algebra(spark):
    a, b, c = ints(spark, 1, 2, 3, 3, None), ints(spark, 2, 3, 4), ints(spark, 3)
    assert sorted(x[0] for x in choices.choice(a, b).collect() if x[0]) == [1, 2, 3, 4]
    assert col(choices.intersection(a, b, c)) == [3]
    assert [x[0] for x in choices.difference(a, b).orderBy("x").collect()] == [None, 1]
    assert choices.identical(c, ints(spark, 3, 3)).first()[0] and not choices.identical(b, c).first()[0]
    assert choices.contains(c, b).first()[0] and not choices.contains(b, c).first()[0]
    assert choices.overlaps(b, c).first()[0] and not choices.overlaps(c, ints(spark, 9)).first()[0]
    assert choices.intersection(a, a.limit(0)).count() == 0
    assert col(choices.try_whole(a.limit(0), c)) == [3]
    assert choices.count_choices(a, F.col("x") > 1).first()[0] == 3
    assert col(choices.for_choices(b, F.array(F.col("x"), F.col("x") * 2))) == [2, 3, 4, 6, 8]


def test_set_columns(spark):
    a = F.array(*map(F.lit, [3, 1, 2, 2]))
    empty = sets.fail("int")
    r = one(spark, sets.choice(a, F.array(F.lit(9))), sets.intersection(a, empty), sets.try_(empty, a), sets.singleton(F.array(F.lit(5), F.lit(5))), sets.singleton(a), sets.smallest(a, lambda x: x % 2), sets.largest(a, lambda x: x % 2), sets.sorted_by(a, lambda x: -x), sets.is_empty(empty), sets.exists_where(a, lambda x: x > 2))
    assert list(r) == [[1, 2, 3, 9], [], [1, 2, 3], 5, None, [2], [1, 3], [3, 2, 1], True, True]


def test_ties_are_kept(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3)], "k string, v long")
    assert col(tables.maximal(df.withColumnRenamed("v", "value")), "k") == ["b", "c"]
    assert col(choices.largest(df, F.col("v")), "k") == ["b", "c"]
    assert col(tables.skim(df.withColumnRenamed("v", "value"), 3), "k") == ["b", "c"]


def test_total_order(spark):
    names = spark.createDataFrame([("bb",), ("a",), ("ccc",), ("z",)], "s string")
    assert [r[0] for r in names.orderBy(order.order_key(F.col("s"), "string")).collect()] == ["a", "z", "bb", "ccc"]
    assert [r[0] for r in names.orderBy("s").collect()] == ["a", "bb", "ccc", "z"]
    assert one(spark, order.any_less(F.lit(10**6), "number", F.lit("a"), "string")).c0


def test_pick_n_is_repeatable(spark):
    df = ints(spark, *range(20))
    assert col(choices.pick_n(df, 4, 1)) == col(choices.pick_n(df.repartition(3), 4, 1))
    assert choices.pick_n(df, 40).count() == 20


@pytest.fixture(scope="module")
def kb(spark):
    rows = [(1, "type", "dog"), (1, "color", "black"), (2, "type", "dog"), (2, "color", "white"), (3, "type", "cat"), (3, "color", "black"), (4, "type", "dog"), (4, "color", "black"), (4, "size", "big")]
    return FrameStore(spark.createDataFrame(rows, "oid long, slot string, value string"))


def test_search(spark, kb):
    ix = Index.index_frames(kb)
    assert col(search.find_frames(ix, ("type", ["dog"]), ("color", ["black", "white"]))) == [1, 2, 4]
    assert col(search.find_frames(ix, ("type", ["dog"]), ("color", ["green"]))) == []
    assert sorted(map(tuple, search.scores(ix, ("type", ["dog"]), ("color", ["black"])).collect())) == [(1, 2), (2, 1), (3, 1), (4, 2)]
    one_ = spark.createDataFrame([(1,)], "oid long")
    assert col(search.find_similar(ix, one_, ["type", "color"])) == [1, 4]
    assert sorted(map(tuple, search.similar_scored(ix, one_, ["type"]).collect())) == [(4, 2)]
    alone = spark.createDataFrame([(3,)], "oid long")
    assert sorted(map(tuple, search.similar_scored(ix, alone, ["type"]).collect())) == [(3, 0)]


def test_index_stop_slots_and_sizes(spark, kb):
    assert {r.slot for r in Index.index_frames(kb, stop_slots=("size",)).keys().collect()} == {"type", "color"}
    assert {r.slot for r in Index.index_frames(kb, ["size"], stop_slots=("size",)).keys().collect()} == {"size"}
    ix = Index.index_frames(kb)
    both = {(r.slot, r.value): r.n for r in Index.compound(ix, ix).get_size().collect()}
    assert both["type", "dog"] == 6


def test_slot_updates(spark, kb):
    change = spark.createDataFrame([(1, "color", "brown")], "oid long, slot string, value string")
    assert col(kb.add(change).pget("color").filter("oid = 1"), "value") == ["black", "brown"]
    assert col(kb.set_(change).pget("color").filter("oid = 1"), "value") == ["brown"]
    assert kb.zap(change).pget("color").filter("oid = 1").count() == 0
    assert col(kb.pick(("type", ["dog"]), ("color", ["black"]))) == [1, 4]
    back = FrameStore.import_frames(kb.export_frames()).slots
    assert back.exceptAll(kb.slots).count() == 0 and back.count() == kb.slots.count()


def test_computed_slots(spark, kb):
    derive = lambda s: s.pget("size").select("oid", F.lit("heavy").alias("value"))
    store = FrameStore(kb.slots, {"color": derive})
    assert col(store.get("color"), "value") == ["heavy"]
    assert store.cachable_get("color").count() == 4


def test_closure_is_reflexive_and_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    roots = spark.createDataFrame([(1,), (4,), (9,)], "root long")
    got = sorted(map(tuple, closures.get_star(roots, edges).collect()))
    assert got == [(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (9, 9)]


def test_pools(spark):
    got = pools.allocate(spark.range(100).repartition(7), 1000)
    assert col(got.select("oid")) == list(range(1000, 1100))
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "oid long, value string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "oid long, value string")
    assert sorted(map(tuple, pools.diff(old, new).collect())) == [(2, "modified"), (3, "dropped"), (4, "added")]
    assert pools.allocate_ranges((0, 100), 10, [("x", 40), ("y", 50)]) == [(10, 40, "x"), (50, 50, "y")]
    with pytest.raises(ValueError):
        pools.allocate_ranges((0, 100), 10, [("x", 91)])


def test_numbers(spark):
    r = one(spark, numbers.divide(F.lit(6), F.lit(-4)), numbers.quotient(F.lit(-7), F.lit(2)), numbers.remainder(F.lit(-7), F.lit(2)), numbers.modulo(F.lit(-7), F.lit(2)), numbers.modulo(F.lit(7), F.lit(-2)), numbers.gcd(F.lit(84), F.lit(36), F.lit(60)), numbers.lcm(F.lit(4), F.lit(6)), numbers.ilog(F.lit(1025)), numbers.truncate(F.lit(-2.7)), numbers.divide(F.lit(1), F.lit(0)), numbers.string_to_number(F.lit("-ff"), 16), numbers.string_to_number(F.lit("x")), numbers.scalerep(F.lit(1.26), -10))
    assert [tuple(x) if isinstance(x, tuple) else x for x in r] == [(-3, 2), -3, -1, 1, -1, 12, 12, 11, -2, None, -255, None, (13, -10)]


def test_strings(spark):
    r = one(spark, strings.string_capitalize(F.lit("o'neil met the.KING")), strings.std_space(F.lit("  a\t b\n\nc ")), strings.alphabetic_percent(F.lit("")), strings.whitespace_percent(F.lit("a\tb ")), strings.get_bigrams(F.lit("AbAB")), strings.strip_margin(F.lit("--a  b!?c")), strings.string_lower_base(F.lit("Éà")), strings.integer_to_char(F.lit(128512)), strings.suffix_rule(F.lit("ponies"), [("ies", "y"), ("s", "")]), strings.substring(F.lit("hello"), 1, 3), strings.is_numeric(F.lit("")))
    assert list(r) == ["O'neil Met The.King", "a b c", 0, 125, ["ab", "ba"], "a b!c", "ea", "😀", ["ponie", "pony"], "el", True]


def test_stems():
    for word, stem in {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "relational": "relat", "conflated": "conflat", "happy": "happi", "probate": "probat", "controlling": "control", "sky": "sky"}.items():
        assert text.porter(word) == stem


def test_names(spark):
    assert text.names_in("Yesterday Dr. Anna Lee met The King of Spain, said Bob.") == ["Bob", "Dr. Anna Lee", "King", "Spain", "Yesterday"]


def test_patterns(spark):
    p = patterns.seq(patterns.label("user", patterns.one_or_more(patterns.ISALNUM)), "@", patterns.label("host", patterns.char_not(" @")))
    r = one(spark, patterns.tx_extract(p, F.lit("bob@x.org")), patterns.tx_match({"a", "ab"}, F.lit("AB")), patterns.tx_match(patterns.match_case("ab"), F.lit("AB")), patterns.tx_search("b", F.lit("abc")), patterns.tx_search("z", F.lit("abc")), patterns.gather({"a", "ab"}, F.lit("ab a ab")), patterns.segment(F.lit("a-b, c")), patterns.fragment(F.lit("a, b")), patterns.tx_matcher_ends(patterns.plus("ab"), F.lit("ababx")), patterns.tx_subst(patterns.seq("a", patterns.subst("b", "X")), F.lit("abcab")))
    assert tuple(r[0]) == ("bob", "x.org")
    assert list(r)[1:] == [True, False, 1, None, ["a", "ab"], ["a", "b", "c"], ["a", ", ", "b"], [2, 4], "aXcaX"]


def test_sequences(spark):
    a = F.array(*map(F.lit, [1, 2, 3, 2]))
    r = one(spark, sequences.position(F.lit(2), a), sequences.position(F.lit(9), a), sequences.search(F.array(F.lit(3), F.lit(2)), a), sequences.mismatch(a, F.array(F.lit(1), F.lit(2))), sequences.mismatch(a, a), sequences.subseq(a, 1, 3), sequences.set_elt(a, 0, 7), sequences.list_tail(a, 3), sequences.map2(lambda x, y: x * y, a, F.array(F.lit(10), F.lit(20))), sequences.elt(a, 10))
    assert list(r) == [1, None, 2, 2, None, [2, 3], [7, 2, 3, 2], [2], [10, 40], None]


def test_times(spark):
    noon = F.lit("2024-03-05 12:30:00").cast("timestamp")
    r = one(spark, times.get_daytime(noon), times.get_season(noon), times.get_timekeys(noon, "month"), times.later(noon, noon), times.earlier(noon, noon), times.parse_iso8601(F.lit("2024-03"))["precision"], times.parse_iso8601(F.lit("no"))["precision"])
    assert list(r) == [[], ["WINTER"], ["2024", "3/2024", "MAR", "SPRING", "WINTER"], True, False, "month", None]


def test_timespecs_and_keys(spark):
    noon = F.lit("2024-03-22 12:05:00").cast("timestamp")
    r = one(spark, times.parse_timespec(F.lit("May-August 1996-1998 x 3 3/7 summer")), times.parse_timespec(F.lit("Nov-feb")), times.get_timekeys(noon, "second"))
    assert r.c0 == [["MAY", "JUN", "JUL", "AUG"], ["1996", "1997", "1998"], ["3RD"], ["3/7"], ["SUMMER"]]
    assert r.c1 == [["NOV", "DEC", "JAN", "FEB"]]
    assert set(r.c2) == {"2024", "SPRING", "MAR", "3/2024", "22ND", "FRI", "W12", "3/22", "NOON", "12:05", "WINTER"}


def test_geo(spark):
    from framesift.functions import geo

    r = one(spark, geo.float_to_dms(F.lit(-71.5042)), geo.dms_to_float(F.lit("-6:30")), geo.degree_keys(F.lit(42.25)), geo.lon_plus(F.lit(179.0), 2.0), geo.parse_nmea(F.lit("$GPRMC,123519,A,4807.038,N,01131.000,W,022.4,084.4,230394,003.1,W*6A")), geo.geodistance(0.0, 0.0, 0.0, 1.0), geo.span_keys(F.lit(1.2), F.lit(3.0), 1.0))
    assert r.c0 == "-0713015" and r.c1 == -6.5 and r.c2 == ["+042", "+04215", "+0421500"] and r.c3 == -179.0
    assert round(r.c4["lat"], 4) == 48.1173 and round(r.c4["long"], 4) == -11.5167 and str(r.c4["time"]) == "1994-03-23 12:35:19"
    assert round(r.c5, 3) == 60 * 1852 and r.c6 == [2.0, 3.0]


def test_rationalize_by_brute_force_in_time(spark):
    """All 1,000 denominators for every row took 38 s over as many rows."""
    import math
    import time

    import numpy as np

    tolerance = 0.001
    xs = [*(k / 60 for k in range(-200, 2000)), *((2 * k + 1) / 1000 for k in range(-600, 600)), *(tolerance + k / 4e6 for k in range(400)), *np.random.default_rng(1).normal(0, 3, 16_200), 1e17, -1e17, 0.0, -0.0, 5e-324]
    d = np.arange(1.0, 1001.0)
    expected = []
    for x in xs:
        whole, rounded = np.floor(abs(x) * d), np.abs(x) * d
        rounded = whole + (rounded - whole >= 0.5)
        den = int(d[np.argmax(np.abs(rounded / d - abs(x)) <= tolerance)])
        expected.append((int(math.copysign(rounded[den - 1], x)), den))
    frame = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)] + [(-1, None), (-2, float("nan")), (-3, float("inf"))], "i long, x double").coalesce(1).cache()
    frame.count()
    began = time.perf_counter()
    got = {r.i: r.q for r in frame.select("i", numbers.rationalize(F.col("x"), tolerance).alias("q")).collect()}
    took = time.perf_counter() - began
    assert [tuple(got[i]) for i in range(len(xs))] == expected and all(got[i] is None for i in (-1, -2, -3))
    assert took < 20, took


def test_dms_keeps_the_degree(spark):
    from framesift.functions import geo

    r = one(spark, *(geo.float_to_dms(F.lit(x)) for x in (44.9999, -44.9999, 45.0, 0.9999, 10.01, 12.0166, -0.5)), geo.degree_keys(F.lit(44.9999)), geo.float_to_dms(F.lit(None).cast("double")))
    assert list(r)[:7] == ["+0446000", "-0446000", "+0450000", "+0006000", "+0100036", "+0120100", "-0003000"]
    assert r.c7 == ["+044", "+04460", "+0446000"] and r.c8 is None


def test_dms_keys_near_whole_degrees(spark, tmp_path):
    import duckdb

    from framesift.plans import catalog

    spark.createDataFrame([(1, 4499.99), (2, -4499.99), (3, 99.99), (4, 4500.0), (5, -0.01), (6, 0.0), (7, None)], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    sql = catalog.SQL["dms_keys"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = {r.c_custkey: r.degrees for r in catalog.QUERIES["dms_keys"](spark, str(tmp_path)).collect()}
    assert got == dict(duckdb.connect().sql(sql).fetchall()) and got[1] == "+044"


def test_geo_range_join_repeated_keys_and_one_place(spark, tmp_path):
    """Rows of one key each count, as in the SQL, also where all customers share a latitude and fill several lists."""
    import duckdb

    from framesift.plans import catalog

    customers, suppliers = [*(120 * i + 70 for i in range(20_000)), 70, 70, 71, 72, 9, -50, None], [10, 10, 60, 9, 12, -1, None]
    for name, key, keys in (("customer", "c_custkey", customers), ("supplier", "s_suppkey", suppliers)):
        spark.createDataFrame([(k,) for k in keys], f"{key} long").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = catalog.QUERIES["geo_range_join"](spark, str(tmp_path)).groupBy("s_suppkey", "c_custkey").count().toPandas()
    con = duckdb.connect()
    for name in ("customer", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(f"SELECT s_suppkey, c_custkey, count(*) AS count FROM ({catalog.SQL['geo_range_join']}) GROUP BY ALL").df()
    assert rows(got) == rows(want) and got["count"].max() == 6


def test_urls_and_markup(spark):
    m = urls.url_to_slotmap(F.lit("http://a.b.org:81/x/y.tar.gz?q=1#f"))
    r = one(spark, urls.slotmap_to_url(m), m["suffix"], urls.normalize_url(F.lit("../z.html"), F.lit("http://h/a/b/c.html")), urls.get_domains(F.lit("a.b.c")), markup.xml_get(F.lit("<r><a>1</a><a>2</a></r>"), "a"), markup.unparse_markup(markup.parse_xml(F.lit("<r i='1'>x<b/>y</r>"))), markup.parse_xml(F.lit("<r>")), markup.read_mime(F.lit("A: b\n\nbody")))
    assert list(r) == ["http://a.b.org:81/x/y.tar.gz?q=1#f", "gz", "http://h:80/a/z.html", ["a.b.c", "b.c", "c"], ["1", "2"], '<r i="1">x<b/>y</r>', None, {"a": "b", "content": "body"}]


@pytest.mark.parametrize("x", [None, True, 0, -5, 2**40, 1.5, "é", b"\x00\xff", [1, ["a", None], 2.0], [], binary.Symbol("NAME")])
def test_binary_round_trip(x):
    back = binary.decode(binary.encode(x))
    assert back == (None if x == [] else x) and type(back) is (type(None) if x == [] else type(x))


def test_binary_rejects_damage():
    with pytest.raises(ValueError):
        binary.decode(binary.encode("abc")[:-1])
    with pytest.raises(ValueError):
        binary.decode(b"\xee")


def test_binary_files(tmp_path):
    p = str(tmp_path / "values")
    binary.write_file(p, 1, "two")
    binary.write_file(p, [3.0])
    assert binary.read_file(p) == [1, "two", [3.0]]


def test_control_and_predicates(spark):
    from framesift.functions import control

    r = one(spark, control.comma_list(F.array(*map(F.lit, ["a"]))), control.unless(F.lit(None).cast("boolean"), 1), control.cgi_vars(F.lit("a=1&b=x%20y&a=2&c")), numbers.is_integer(F.lit(1)), numbers.is_inexact(F.lit(1)), numbers.rationalize(F.lit(0.3333), 0.001), sequences.is_vector(F.array()), sequences.is_string(F.lit(1)), sequences.member(F.lit(2), F.array(F.lit(1), F.lit(2), F.lit(3))), times.parse_timestring(F.lit("3/4/2024"))["ts"].cast("string"), patterns.canonical(F.lit(" É  b ")))
    assert list(r) == ["a", 1, {"a": "2", "b": "x y", "c": ""}, True, False, (1, 3), True, False, [2, 3], "2024-03-04 00:00:00", "e b"]


def test_pairs_and_adjuncts(spark):
    s = FrameStore(spark.createDataFrame([(1, "r", "a=1"), (1, "r", "b=2"), (2, "r", "a=3")], "oid long, slot string, value string"))
    assert col(s.assoc_test("r", "a", "3")) == [2] and col(s.paired_test("r", "b")) == [1]
    one_ = spark.createDataFrame([(1, "9")], "oid long, value string")
    assert col(s.assoc_add("r", "a", one_).assoc_get("r", "a"), "value") == ["1", "3", "9"]
    assert s.paired_drop("r", spark.createDataFrame([(1, "a")], "oid long, value string")).slots.count() == 2
    assert col(s.with_adjunct("x", one_).get("x"), "value") == ["9"]


def test_call_cache(spark):
    c, calls = choices.CallCache(), []

    def f(n):
        calls.append(n)
        return spark.range(n)

    assert c.call(f, 3).count() == 3 == c.call(f, 3).count() and c.call(f, 4).count() == 4
    c.clear(f)
    c.call(f, 3)
    assert calls == [3, 4, 3]


def test_registry_resolves():
    import importlib

    from framesift.registry import coverage

    found = coverage()
    assert {"FIND-FRAMES", "CHOICE", "HASHTABLE-SKIM", "GET*", "FD:INVERSE-GET", "TX-EXTRACT", "SINGLETON?"} - set(found) <= {"SINGLETON?"}
    for places in found.values():
        for place in places:
            where, name = place.split(":")
            package, module, *cls = where.split(".")
            owner = importlib.import_module(f"framesift.{package}.{module}")
            for c in cls:
                owner = getattr(owner, c)
            assert hasattr(owner, name)


def test_records(spark):
    df = spark.createDataFrame([(1, "a--b---c"), (2, "")], "id long, text string")
    got = [tuple(r) for r in records.records(df, F.col("text"), "-+", ["id"]).orderBy("position").collect()]
    assert got == [(1, 0, "a", ""), (1, 1, "b", "--"), (1, 2, "c", "---")]


def test_change_feed(spark):
    log = spark.createDataFrame([(1, "k", "add", "x"), (2, "k", "drop", "x"), (3, "j", "add", "y")], "stamp long, key string, op string, value string")
    store = spark.createDataFrame([("k", "x"), ("k", "z")], "key string, value string")
    assert sorted(map(tuple, changes.apply_changes(store, log).collect())) == [("j", "y"), ("k", "z")]
    assert col(changes.changes_since(log, 2)) == ["j"]
    assert changes.needs_refresh(changes.ring(log, 1), 1).first()["refresh"]
    assert not changes.needs_refresh(changes.ring(log, 1), 2).first()["refresh"]


def test_closure_of_a_long_chain_is_whole(spark):
    from framesift.operators import closures

    edges = spark.createDataFrame([(i, i + 1) for i in range(24)], "src int, dst int")
    assert closures.get_star(spark.createDataFrame([(0,)], "root int"), edges).count() == 25


def test_association_values_keep_their_signs(spark):
    from framesift.operators.frames import FrameStore

    store = FrameStore(spark.createDataFrame([("o", "s", "click=a=b"), ("o", "s", "clicks=c"), ("p", "s", "click=")], "oid string, slot string, value string"))
    assert sorted(map(tuple, store.assoc_get("s", "click").collect())) == [("o", "a=b"), ("p", "")]
    assert [r.oid for r in store.assoc_test("s", "click", "a=b").collect()] == ["o"]


def test_names_begin_with_no_function_word():
    from framesift.functions.text import names_in

    assert names_in("After Mary Jones left, Because of it During June Dr. Paul Smith came.") == ["Dr. Paul Smith", "June", "Mary Jones"]


def test_a_cluster_must_name_its_shared_folder():
    import pytest

    from framesift import scratch

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://one:7077"})

    with pytest.raises(RuntimeError):
        scratch.checkpoint_root(Cluster())


def test_more_clauses_than_bits(spark):
    rows = spark.createDataFrame([(1, "s", str(i)) for i in range(130)] + [(2, "s", str(i)) for i in range(129)] + [(3, "s", "129")], "oid long, slot string, value string")
    clauses = [("s", [i]) for i in range(130)]
    index = Index.index_values(rows)
    assert [r.oid for r in search.find_frames(index, *clauses).collect()] == [1]
    assert {r.oid: r.score for r in search.scores(index, *clauses).collect()} == {1: 130, 2: 129, 3: 1}
    assert [r.oid for r in FrameStore(rows).pick(*clauses).collect()] == [1]
    with pytest.raises(ValueError):
        search.find_frames(index)
