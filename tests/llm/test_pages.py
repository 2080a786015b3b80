"""Page text and URL filters against plain versions."""

import html
import re

import pytest
from helpers import collected
from pyspark.sql import functions as F

from framesift.llm import pages, urls

ODD = [
    (-1, None, None), (-2, "x", ""), (-2, "x", ""), (None, "http://h/", "<p>lost"), (-3, "http://h/a", "just text &amp; more"),
    (-4, "http://h/b", '<html><body class="has-sidebar"><div id=menu>m</div><header>h</header><article><header><h1>T &amp; x</h1>by</header><p>one<p>two <i>3</i>4<div class="comments"><p>no</div>z<ul><li>a<li>b</ul><script>"</article>"</script></article><div class=sidebar>q</div>'),
    (-5, "http://h/c", "<main><p>kept<form>gone</form><p>also<aside>no</aside></main><footer>no</footer>"),
    (-6, "http://h/d", "<article>" + "<p>long text here</p>" * 20000 + "</article>"),
    (-7, "http://h/e", "<div><div><div><p>a</div><b>b < c &lt; d</b><!-- x --><style>p{}</style></p></article></div>e"),
]


def article_text(source):
    m = re.search(r"<article>(.*?)</article>", source, re.S)
    parts = re.split(r"</?(?:h1|p)>", m[1])
    clean = [" ".join(html.unescape(re.sub(r"<[^>]+>", lambda t: " " if t[0] == "<br>" else "", p)).split()) for p in parts]
    return " ".join(p for p in clean if p)


def test_extraction(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame(ODD, "page_id long, url string, html string")
    both = table.unionByName(extra).withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = collected(pages.extract(both))
    assert len(got) == table.count() + len(ODD)
    text = {r["page_id"]: r["text"] for r in got}
    for r in table.collect():
        assert text[r.page_id] == article_text(r.html)
    assert text[-1] == text[-2] == "" and text[None] == "lost"
    assert text[-4] == "T & x one two 34 z a b"
    assert text[-5] == "kept also"
    assert text[-6] == " ".join(["long text here"] * 20000)
    assert text[-7] == "a b < c < d e"


def test_wrapper_drops_constant_blocks_without_article(spark):
    page = lambda i: f"<body><div class=top>Our site since 1999</div><div class=body><h1>Title {i}</h1><p>Story {i} goes on</p></div><div class=end>All pages say this</div></body>"
    rows = [(i, f"http://one.example/{i}", page(i)) for i in range(12)] + [(100, "http://two.example/1", page(100))]
    got = {r["page_id"]: r["text"] for r in collected(pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    assert got[3] == "Title 3 Story 3 goes on"
    assert got[100].startswith("Our site")  # one page tells nothing about a template


def test_large_wrappers_are_joined(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    a = collected(pages.extract(table))
    b = collected(pages.extract(table, pages.WrapperConfig(max_wrapper_bytes=0)))
    assert sorted((r["page_id"], r["text"]) for r in a) == sorted((r["page_id"], r["text"]) for r in b)


def test_tree_matching():
    a = pages.read_shape("body(h1 div.x(p) div.y(p ul(li)))")
    b = pages.read_shape("body(div.x(p) nav div.y(ul(li)))")
    size, pairs = pages.align(a, b)
    assert size == 6 == len(pairs)
    assert all(x.label == y.label for x, y in pairs)
    assert pages.align(a, pages.read_shape("html"))[0] == 0
    assert pages.shape(a) == "body(h1 div.x(p) div.y(p ul(li)))"


def test_extraction_of_empty_table(spark, sf):
    assert pages.extract(spark.read.parquet(f"{sf}/pages.parquet").limit(0)).count() == 0


URLS = [
    (1, None, "", "", None, "allow"), (2, "", "", "", None, "allow"), (3, "a.org/x", "", "", None, "allow"), (4, "HTTP://A.Org", "a.org", "", None, "allow"), (5, "http://A.Org/", "a.org", "/", "org/", "allow"),
    (6, "http://x.example.org/es/1", "x.example.org", "/es/1", "example.org/es/", "block"), (7, "http://example.org/en/15", "example.org", "/en/15", "example.org/en/1", "block"), (8, "http://example.org/en/25", "example.org", "/en/25", "org/", "allow"),
    (9, "http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"), (10, "http://a.com/de/adult", "a.com", "/de/adult", "com/de/", "block"), (11, "http://adult.com/fr/x", "adult.com", "/fr/x", "com/fr/", "allow"),
    (12, "http://my-adult.net/", "my-adult.net", "/", None, "block"), (13, "http://adultery.net/", "adultery.net", "/", None, "allow"), (14, "http://cheap.net/a", "cheap.net", "/a", None, "allow"), (15, "http://cheap.net/pills?cheap", "cheap.net", "/pills", None, "block"),
    (16, "http://cheap.net/cheap", "cheap.net", "/cheap", None, "allow"), (17, "x://h?q=/en/", "h", "", None, "allow"), (18, "x://h#/en/", "h", "", None, "allow"), (None, "http://a.org/x", "a.org", "/x", "org/", "allow"),
]


@pytest.mark.parametrize("again", [1, 2])
def test_urls(spark, again):
    df = spark.createDataFrame([(r[0], r[1], "clash") for r in URLS] * again, "page_id long, url string, host string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in collected(urls.judge_urls(df))), key=repr)
    assert got == sorted(((r[0], *r[2:]) for r in URLS * again), key=repr)
    assert urls.judge_urls(df.limit(0)).count() == 0
