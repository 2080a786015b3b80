"""Near-duplicates of clashing ids, of hot groups, and whole rows with one of each component."""

import random
from collections import Counter

import pytest
from helpers import collected

from framesift.llm import neardup

R = random.Random(4)
WORD = [a + b for a in "ka lo mi nu pe ri sa to".split() for b in "ba de fi go hu".split()]


def text(n=60):
    return " ".join(R.choice(WORD) for _ in range(n))


def near(t, n=1):
    w = t.split()
    for _ in range(n):
        w[R.randrange(len(w))] = "changed" + R.choice(WORD)
    return " ".join(w)


def plain(rows):
    """(a name of the component, component_id) of each row by all pairs; rows are nodes by id and text."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = d if top(i) not in least or d is None else min(least[top(i)], d)
    return [(top(i), least[top(i)]) for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    long = text(400)
    groups = [text() for _ in range(12)]
    out = [(i, near(groups[i % 12], i % 3)) for i in range(60)]
    out += [(100 + i, near(long, 2)) for i in range(90)]  # a hot group of near copies, each its own text
    out += [(5, text()), (5, near(groups[7], 1)), (200, groups[3]), (200, text()), (300, "a b"), (300, "a b"), (301, "A b"), (302, None), (303, ""), (303, ""), (None, groups[1]), (None, None), (None, groups[1])]
    return out


@pytest.mark.parametrize("config", [neardup.NearDupConfig(), neardup.NearDupConfig(star=3, block=8)])
def test_clashing_ids_and_hot_groups(spark, rows, config):
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, node string").repartition(5)
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in collected(neardup.near_duplicates(df, config)))
    want = plain(rows)
    assert got == Counter((d, c, d == c) if d is not None else (None, None, True) for (d, _), (_, c) in zip(rows, want))


def test_one_of_each(spark, rows):
    df = spark.createDataFrame([(*r, i, "c") for i, r in enumerate(rows)], "doc_id long, text string, _may int, _id string").repartition(5)
    out = neardup.one_of_each(df)
    assert out.columns == df.columns
    got = collected(out)
    comps = plain(rows)
    words = {c for (d, t), c in zip(rows, comps) if d is not None and (t or "").split()}
    assert sorted(comps[r["_may"]] for r in got if r["doc_id"] is not None and (r["text"] or "").split()) == sorted(words)
    assert len({c for _, c in words}) < len(words)  # two components of one id are two
    assert all(r["doc_id"] == comps[r["_may"]][1] for r in got if r["doc_id"] is not None)
    assert Counter((r["doc_id"], r["text"]) for r in got if r["doc_id"] is None or not (r["text"] or "").split()) == Counter([(302, None), (303, ""), *((d, t) for d, t in rows if d is None)])


def test_without_clashes_and_empty(spark, rows):
    own = [r for r in dict(rows).items() if r[0] is not None]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in collected(neardup.near_duplicates(df))} == dict(zip((d for d, _ in own), (c for _, c in plain(own))))
    assert neardup.near_duplicates(df.limit(0)).count() == 0 and neardup.one_of_each(df.limit(0)).count() == 0
