"""Wrapper induction: what only the wrapper can tell, and markup that is deep, hot or copied."""

import itertools

from helpers import collected

from framesift.llm import pages


def texts(spark, rows, config=pages.WrapperConfig()):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in collected(pages.extract(df, config))}


def story(i, share="Tell your friends about us", note="The editors"):
    return f"<div class=zz>Est 1999</div><article><h1>Title {i}</h1><p>Story {i} goes on and on, and further than that, past every hill and every river</p><p>It ends at {i * 7} of them</p><p>{share}</p><div class=q>{note}</div></article>"


def test_only_the_wrapper_separates(spark):
    """No name in the page is on a list: constant slots go, varying ones stay, and one page alone keeps all."""
    page = lambda i: f"<div class=aa><ul><li>Home</li><li>Shop</li></ul></div><div class=bb><h2>On {i}</h2><p>Text {i}</p><p>More of {i}</p></div><div class=cc>Imprint</div>"
    got = texts(spark, [(i, f"http://two.example/{i}", page(i)) for i in range(20)] + [(100, "http://three.example/", page(5))])
    assert got == {i: f"On {i} Text {i} More of {i}" for i in range(20)} | {100: "Home Shop On 5 Text 5 More of 5 Imprint"}


def test_constant_blocks_of_articles(spark):
    rows = [(i, f"http://one.example/{i}", story(i)) for i in range(20)]
    rows += [(100, "http://one.example/x", story(100, "One of a kind", "A guest"))]
    got = texts(spark, rows)
    assert all(got[i] == f"Title {i} Story {i} goes on and on, and further than that, past every hill and every river It ends at {7 * i} of them" for i in range(20) if i)
    assert got[100].endswith("One of a kind A guest")
    assert texts(spark, rows, pages.WrapperConfig(spare=0.0))[5].endswith("Tell your friends about us The editors")


def test_copies_make_no_template(spark):
    """A page that is there many times, or a host of near copies, keeps its text."""
    page = lambda i: f"<article><h1>The same</h1><p>All of this is the same on every page</p><p>But for {i}</p></article>"
    rows = [(i, f"http://one.example/{i}", page(7)) for i in range(30)] + [(100 + i, f"http://two.example/{i}", page(i)) for i in range(30)]
    got = texts(spark, rows)
    assert got[3] == "The same All of this is the same on every page But for 7"
    assert got[103] == "The same All of this is the same on every page But for 3"


def test_deep_and_long_markup(spark):
    deep = "<div>" * 5000 + "inner" + "</div>" * 5000 + "<p>outer"
    lists = "<ul><li>" * 3000 + "item"
    many = "".join(f"<section class={''.join(chr(97 + int(c)) for c in str(i))}>{i}</section>" for i in range(800))
    rows = [(i, "http://deep.example/", deep) for i in range(6)] + [(10 + i, "http://lists.example/", lists) for i in range(6)] + [(20, "http://many.example/", many)]
    got = texts(spark, rows)
    assert got[0] == got[5] == "inner outer" and got[10] == "item" and got[20].startswith("0 1 2 ") and got[20].endswith(" 799")


def test_inner_end_tags_do_not_end_chrome(spark):
    assert texts(spark, [(1, "h", "<p>a <span class=ad>x <span>y</span> z</span> b</p>")]) == {1: "a b"}


def test_some_wrappers_sent_and_others_joined(spark):
    rows = [(100 * h + i, f"http://h{h}.example/{i}", story(i, f"Constant of {h}")) for h, n in enumerate((30, 8, 8, 6)) for i in range(1, n + 1)]
    whole = texts(spark, rows)
    for limit in (0, 200, 10**6):
        assert texts(spark, rows, pages.WrapperConfig(max_wrapper_bytes=limit)) == whole


def test_alignment_is_the_largest():
    """Against all ways of matching rows of children in order."""

    def tree(spec):
        return pages.read_shape(spec)

    def largest(a, b):
        if a.label != b.label:
            return 0
        xs, ys = list(a.children.values()), list(b.children.values())
        best = 0
        for k in range(min(len(xs), len(ys)) + 1):
            for i in itertools.combinations(xs, k):
                for j in itertools.combinations(ys, k):
                    best = max(best, sum(largest(x, y) for x, y in zip(i, j)) if all(x.label == y.label for x, y in zip(i, j)) else 0)
        return 1 + best

    specs = ["r(a(x y) b c(z))", "r(b a(y x) c(z))", "r(c(z w) b(q) a(x))", "r(a b c d e)", "r(e d c b a)", "r(c d a b e(x))", "r"]
    for s, t in itertools.product(specs, specs):
        size, pairs = pages.align(tree(s), tree(t))
        assert size == largest(tree(s), tree(t)) == len(pairs)
