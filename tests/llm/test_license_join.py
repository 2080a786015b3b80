"""The join of text windows with license templates, against trying every window."""

import random
import re

from helpers import collected

from framesift.llm import licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text, config):
    w = WORDS.findall((text or "").lower())
    best = {}
    for label, t in config.templates:
        tokens, size = set(t.split()), -(-len(t.split()) * 100 // round(100 * config.threshold))
        share = max((len(tokens.intersection(w[i : i + size])) / len(tokens) for i in range(len(w))), default=0)
        if share >= config.threshold - 1e-9:
            best[label] = max(best.get(label, 0), share)
    return best


def test_random_texts(spark):
    """Texts made of the templates' own words in any order and with any words between."""
    r = random.Random(2)
    config = licenses.LicenseConfig()
    vocabulary = sorted({w for _, t in config.templates for w in t.split()})
    rows = [(0, None), (1, ""), (2, "the mit crew released news of the harbour while walking under the bridge"), (3, "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this\nsoftware and associated documentation files")]
    for i in range(4, 160):
        parts = []
        for _ in range(r.randint(1, 5)):
            t = r.choice(config.templates)[1].split()
            t = [w for w in t if r.random() > r.choice((0, 0.1, 0.25))]
            if r.random() < 0.4:
                r.shuffle(t)
            if r.random() < 0.5:
                t = [x for w in t for x in ([w, "filler"] if r.random() < 0.25 else [w])]
            parts += t + [r.choice((*vocabulary, "filler", "words", "here")) for _ in range(r.choice((0, 5, 60, 120)))]
        rows.append((i, " ".join(w.upper() if r.random() < 0.1 else w + r.choice(("", "", ",", "\n")) for w in parts)))
    rows.append((1000, "mit license " * 20000))
    got = {x["doc_id"]: x for x in collected(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), config))}
    for i, text in rows[:-1]:
        best = plain(text, config)
        assert {b.label for b in got[i]["blocks"]} == set(best), i
        assert got[i]["score"] == (1.0 if got[i]["n_base"] else max(best.values(), default=0.0)), i
        for b in got[i]["blocks"]:  # the place given holds the share given
            size, tokens = next((-(-len(t.split()) * 100 // 80), set(t.split())) for label, t in config.templates if label == b.label and len(tokens := set(t.split())) and abs(len(tokens.intersection(WORDS.findall(text.lower())[b.at : b.at + -(-len(t.split()) * 100 // 80)])) / len(tokens) - b.share) < 1e-9)
            assert size and tokens
    assert got[2]["labels"] == "" and got[2]["score"] == 0.0
    assert got[3]["labels"] == "mit" and got[3]["score"] == 1.0
    assert got[1000]["n_base"] == 20000 and got[1000]["labels"] == "mit"


def test_other_templates_and_none(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma x x x x alpha beta")], "doc_id long, text string")
    own = licenses.LicenseConfig(threshold=1.0, templates=(("greek", "alpha beta gamma"),))
    assert {r["doc_id"]: r["labels"] for r in collected(licenses.scan_licenses(df, own))} == {1: "greek", 2: ""}
    assert {r["doc_id"]: r["labels"] for r in collected(licenses.scan_licenses(df, licenses.LicenseConfig(templates=())))} == {1: "", 2: ""}
    assert licenses.scan_licenses(df.limit(0)).count() == 0
