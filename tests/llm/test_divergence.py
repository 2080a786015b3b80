"""Verdicts of the quality rules on texts that differ from their language, beside the SQL that states the same."""

import random

from helpers import collected

from framesift.llm import quality

FILL = [a + b for a in "lor men tar vis gol ket".split() for b in "an er is um ost ial".split()]


def english(r, n):
    return " ".join(r.choice(quality.COMMON_WORDS["en"][:30]) if r.random() < 0.4 else r.choice(FILL) for _ in range(n))


def test_verdicts(spark):
    r = random.Random(3)
    rows = [(i, english(r, r.randint(60, 400)), "en") for i in range(120)]
    bad = {1000: " ".join(r.choice(FILL) + r.choice(FILL) for _ in range(800)), 1001: " ".join(f"{r.choice(FILL)}{r.choice(FILL)} |" for _ in range(100)), 1002: english(r, 200).replace(" ", "### "), 1003: " ".join(str(r.random()) for _ in range(60))}
    rows += [(i, t, "en") for i, t in bad.items()]
    rows += [(2000, english(r, 300), None), (2001, english(r, 300), "xx"), (2002, bad[1000], "xx"), (2003, None, "en"), (2004, english(r, 20), "en"), (2005, "zzz " * 60, "en")]
    got = {x["doc_id"]: x for x in collected(quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")))}
    assert len(got) == len(rows)
    assert all(got[i]["kept"] for i in range(120))
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i in bad)
    assert got[1000]["word_distance"] > 0.3  # no common word at all is the farthest, not exempt
    assert got[2000]["kept"] and got[2001]["kept"] and not got[2002]["kept"] and got[2000]["language"] == "en"
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (2003, 2004, 2005))


def test_junk_does_not_shape_the_reference(spark):
    """A third of the rows from one source of junk: clean texts stay, junk goes."""
    r = random.Random(5)
    rows = [(i, english(r, 150), "en") for i in range(80)] + [(1000 + i, english(r, 150).replace(" ", "$$$ "), "en") for i in range(40)]
    got = collected(quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert {x["doc_id"] for x in got if x["kept"]} == set(range(80))


def test_only_junk_keeps_its_reference(spark):
    """Where no document comes near the first reference, or all fail the base rules, the reference is that of all."""
    rows = [(i, "word " * 3, "en") for i in range(4)]
    got = collected(quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert [x["class_distance"] for x in got] == [0.0] * 4 and not any(x["kept"] for x in got)


def test_empty_table(spark):
    assert quality.quality_verdicts(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
