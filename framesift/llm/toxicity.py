"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows around the hits.

1. Lexicon. Words and word beginnings that mark toxic documents are found by counting, over labelled training rows, in
   how many toxic and other documents each occurs (a map-side sum). The stems that separate best form a trie.
2. Matching. The trie is walked under a Levenshtein automaton: a state is the set of (trie node, edits so far) that are
   still alive, and states are made into a table as they are met, so most words die after a few characters. Exact and
   misspelled terms are told apart.
3. Context. Each hit gets the window of words around it. Quotation marks at it or around it and words of reporting lower
   its weight, words of address and further hits raise it; so a text that quotes a term scores less than one that uses
   it. Marks at the edges of words are no part of them.
4. Score. A logistic regression over about a dozen of these sums, fitted on labelled training rows.

Labels are learned only from rows whose crc32 of the id, as text, is not 2 modulo 4; labels, language, source and id are
no inputs of a score. At most ``max_labelled`` training rows are used (the first by hash of the id: a documented bound
for fitting only); every text of the table is scored whole.

Bounds, all of fitting only: ``max_labelled`` rows, of which an id gives one text; ``max_terms`` learned terms, chosen from
the 20 times as many that separate best, of ``shortest`` to ``longest`` characters where they are beginnings.

Cases: null text counts as empty; empty texts get a score as any other; texts of any length are read whole, in one pass
over their words; without labels of both kinds the score is 0 for texts without seed terms (see ``SEEDS``) and rises with
them; repeated rows score alike; an empty table gives an empty result; an id with several labels counts as toxic if one
says so; extra columns, whatever their names, are not used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

#: Seed terms, used beside what the labels teach.
SEEDS = ("idiot", "moron", "loser", "scum", "stupid", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "bastard", "asshole", "bitch", "whore", "slut", "retard", "dumbass", "vermin")
#: Words of reporting and of address.
REPORTING = frozenset("said says say called calls quote quoted word term wrote writes sagte sagt nannte wort zitat dit appelle mot cite dijo dice llama palabra cita".split())
ADDRESS = frozenset("you your you're yourself u ur du dich dir dein ihr euch tu te toi vous votre tus ti usted ustedes".split())
QUOTES = frozenset("\"'«»“”„‘’‹›")


@dataclass(frozen=True)
class ToxicityConfig:
    threshold: float = 0.3
    max_labelled: int = 20_000
    #: Shortest and longest beginnings that are counted.
    shortest: int = 4
    longest: int = 12
    max_terms: int = 200
    #: A term must occur in so many toxic training documents, and be so many times likelier there.
    min_toxic: int = 4
    min_lift: float = 4.0
    #: Words on either side of a hit.
    window: int = 12


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def _tokens(text: str) -> list[str]:
    return text.lower().split()


_EDGE = re.compile(r"^\W+|\W+$")


def count_terms(rows: DataFrame, config: ToxicityConfig) -> DataFrame:
    """term, toxic, other: training documents with a word that is, or begins with, the term. '$' ends whole words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # sums over a few texts at a time: what a task holds stays small
                sums: dict[str, list[int]] = {}
                for text, label in zip(batch["text"].iloc[at : at + 256], batch["toxic"].iloc[at : at + 256]):
                    seen = set()
                    for w in set(_tokens(text) if isinstance(text, str) else ()):
                        w = _EDGE.sub("", w)
                        if len(w) >= config.shortest and w.isalpha():
                            seen.update(w[:k] for k in range(config.shortest, min(len(w), config.longest) + 1))
                            seen.add(w + "$")
                    for s in seen:
                        sums.setdefault(s, [0, 0])[0 if label else 1] += 1
                yield pd.DataFrame([(k, a, b) for k, (a, b) in sums.items()], columns=["term", "toxic", "other"])

    return rows.select("text", "toxic").mapInPandas(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter(F.col("toxic") >= config.min_toxic)


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, other: int, config: ToxicityConfig) -> list[tuple[str, bool, float]]:
    """(term, whether whole words only, weight), best first. Of nested beginnings with the same evidence the longest stays."""
    lift = lambda a, b: ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (other + 1))
    table = {t: (a, b) for t, a, b in counts}

    def gain(a: int, b: int) -> float:
        total, pos, n = 0.0, toxic, toxic + other
        for x, y in ((a, b), (toxic - a, other - b)):
            for z, share in ((x, pos / n), (y, 1 - pos / n)):
                if z > 0 and share > 0:
                    total += z * math.log(z / ((x + y) * share))
        return total

    ranked = sorted(((gain(a, b), t) for t, (a, b) in table.items() if lift(a, b) >= config.min_lift), key=lambda x: (-x[0], -len(x[1]), x[1]))
    chosen: list[tuple[str, bool, float]] = []
    for g, t in ranked:
        if g < 8 or len(chosen) >= config.max_terms:
            break
        body, whole = t.rstrip("$"), t.endswith("$")
        # a longer beginning with nearly the same documents says the same and misfires less
        while not whole:
            longer = [(table[x][0], x) for x in table if not x.endswith("$") and len(x) == len(body) + 1 and x.startswith(body)]
            if longer and max(longer)[0] >= 0.95 * table[body][0]:
                body = max(longer)[1]
            else:
                break
        if not whole and table.get(body + "$", (0, 0))[0] >= 0.9 * table[body][0]:
            whole = True
        if any(body.startswith(c) and not w for c, w, _ in chosen) or any(body == c for c, _, _ in chosen):
            continue
        a, b = table.get(body + "$" if whole else body, table[t])
        chosen.append((body, whole, math.log(lift(a, b))))
    return chosen


class Lexicon:
    """A trie of terms under a Levenshtein automaton, determinised as words are read.

    An edit costs a substitution, insertion, deletion or swap of neighbours; a term of under 5 characters allows none,
    of 5 to 8 one, of more two. A term that stands for word beginnings matches as soon as it is read through.
    """

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[int, bool, int]] = {}
        self.slack: list[int] = [0]
        self.terms = terms
        for number, (term, whole, _) in enumerate(terms):
            node, edits = 0, 0 if len(term) < 5 else 1 if len(term) <= 8 else 2
            self.slack[0] = max(self.slack[0], edits)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.slack.append(0)
                node = self.next[node][c]
                self.slack[node] = max(self.slack[node], edits)
            self.ends.setdefault(node, (number, whole, edits))
        start = self._closed({(0, 0, ""): 0})
        self.states, self.numbers, self.moves, self.found = [start], {start: 0}, [{}], [self._best(start, False)]
        self.words: dict[str, tuple[int, int] | None] = {}

    def _closed(self, alive: dict[tuple[int, int, str], int]) -> frozenset:
        """With deletions: a term's character that the word lacks."""
        out, work = set(), [k for k in alive]
        while work:
            node, edits, swap = work.pop()
            if (node, edits, swap) in out or edits > self.slack[node]:
                continue
            out.add((node, edits, swap))
            if not swap and edits < self.slack[node]:
                work += [(n, edits + 1, "") for n in self.next[node].values()]
        return frozenset(out)

    def _best(self, state: frozenset, at_end: bool) -> tuple[int, int] | None:
        """(edits, term) of the best term that is complete in the state."""
        hits = [(edits, self.ends[node][0]) for node, edits, swap in state if not swap and node in self.ends and edits <= self.ends[node][2] and (at_end or not self.ends[node][1])]
        return min(hits) if hits else None

    def _move(self, number: int, c: str) -> int:
        alive: dict[tuple[int, int, str], int] = {}
        for node, edits, swap in self.states[number]:
            if swap:
                if c == swap[0]:
                    alive[int(swap[1:]), edits, ""] = 0
                continue
            for d, n in self.next[node].items():
                if d == c:
                    alive[n, edits, ""] = 0
                elif edits < self.slack[n]:
                    alive[n, edits + 1, ""] = 0
                    after = self.next[n].get(c)
                    if after is not None:  # neighbours swapped: this character now, the one passed over next
                        alive[node, edits + 1, d + str(after)] = 0
            if edits < self.slack[node]:
                alive[node, edits + 1, ""] = 0
        state = self._closed(alive)
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.found.append(self._best(state, False))
        return self.numbers[state]

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the term that the word is, or begins with; None."""
        number, best = 0, None
        for c in word:
            moves = self.moves[number]
            number = moves[c] if c in moves else moves.setdefault(c, self._move(number, c))
            if not self.states[number]:
                return best
            if self.found[number] and (best is None or self.found[number] < best):
                best = self.found[number]
        last = self._best(self.states[number], True)
        return min(x for x in (best, last) if x) if best or last else None

    def cached(self, word: str) -> tuple[int, int] | None:
        """The better match of the word as it stands and, where marks stand at its edges, without these."""
        if word not in self.words:
            if len(self.words) > 200_000:
                self.words.clear()
            found = [self.match(w) for w in {word, _EDGE.sub("", word)} if w]
            self.words[word] = min((m for m in found if m), default=None)
        return self.words[word]


FEATURES = ("exact_sum", "exact_max", "exact_distinct", "exact_rate", "misspelled", "misspelled_rate", "quoted", "address", "dense", "hits", "any_exact", "short", "seed", "strong", "any_strong")


def _quoted(words: list[str], i: int, window: int) -> bool:
    """Whether quotation marks stand at the word's edges, or are opened before it and closed after it within the window."""

    def marks(w: str) -> tuple[bool, bool]:
        if w[0].isalnum() and w[-1].isalnum():
            return False, False
        core = _EDGE.sub("", w)
        at = w.find(core) if core else 0
        return not QUOTES.isdisjoint(w[:at] if core else w), not QUOTES.isdisjoint(w[at + len(core) :] if core else w)

    if any(marks(words[i])):
        return True
    for before in reversed(words[max(0, i - window) : i]):
        opens, closes = marks(before)
        if opens and (not closes or not _EDGE.sub("", before)):  # a mark that stands alone is taken to open
            break
        if closes:
            return False
    else:
        return False
    for after in words[i + 1 : i + 1 + window]:
        opens, closes = marks(after)
        if closes:
            return True
        if opens:
            return False
    return False


def features(text: str | None, lexicon: Lexicon, config: ToxicityConfig) -> np.ndarray:
    out = np.zeros(len(FEATURES))
    words = _tokens(text or "")
    cached = lexicon.cached
    hits: list[tuple[int, int, int]] = []
    known = lexicon.words
    for i, w in enumerate(words):
        m = known[w] if w in known else cached(w)
        if m is not None:
            hits.append((i, *m))
    n = len(words)
    out[11] = 1 / math.log2(n + 2)
    if not hits:
        return out
    weights, best, misspelled, quoted, address, dense = 0.0, 0.0, 0.0, 0.0, 0.0, 0
    terms, exact = set(), 0
    places = [h[0] for h in hits]
    for j, (i, edits, term) in enumerate(hits):
        weight = lexicon.terms[term][2]
        around = [w if w[0].isalnum() and w[-1].isalnum() else _EDGE.sub("", w) for w in words[max(0, i - config.window) : i] + words[i + 1 : i + 1 + config.window]]
        in_quotes = _quoted(words, i, config.window)
        told = not REPORTING.isdisjoint(around)
        share = (0.3 if in_quotes else 1.0) * (0.6 if told else 1.0)
        if in_quotes:
            quoted += 1
        if not ADDRESS.isdisjoint(around):
            address += 1
        near = 1
        k = j + 1
        while k < len(hits) and places[k] - i <= config.window:
            near += 1
            k += 1
        dense = max(dense, near)
        if edits:
            misspelled += weight * share / (1 + edits)
        else:
            exact += 1
            weights += weight * share
            best = max(best, weight * share)
            out[13] += max(0.0, weight * share - 5)
            terms.add(term)
            if lexicon.terms[term][0] in SEEDS:
                out[12] += share
    out[:11] = (math.log1p(weights), best, len(terms), 100 * weights / (n + 20), math.log1p(misspelled), 100 * misspelled / (n + 20), quoted, address, dense, math.log1p(len(hits)), float(exact > 0))
    out[12], out[14], out[13] = math.log1p(out[12]), float(out[13] > 0), math.log1p(out[13])
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps: mean, scale, weights (the last is the constant)."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge * len(x) / 100)
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def training_rows(docs: DataFrame, labels: DataFrame, config: ToxicityConfig) -> DataFrame:
    """text and toxic of at most about ``max_labelled`` training rows, chosen by hash of the id among all of them."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic")
    n = usable.count()
    share = min(1.0, config.max_labelled / max(n, 1))
    usable = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # about max_labelled rows of two numbers, whatever the table; an id gives one text (the first by hash), however many
    # rows it has, so what is learned from is bounded too
    found = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("t.text", "toxic")


@dataclass
class Scorer:
    terms: list[tuple[str, bool, float]]
    mean: np.ndarray | None
    scale: np.ndarray | None
    weights: np.ndarray | None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return x[:, 12] / (1 + x[:, 12])
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> Scorer:
    rows = shared_table(training_rows(docs, labels, config))
    n = {r.toxic: r.n for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    seeds = [(s, True, 3.0) for s in SEEDS]
    if not n.get(True) or not n.get(False):
        return Scorer(seeds, None, None, None)
    counted = count_terms(rows.withColumn("toxic", (F.col("toxic") > 0).cast("int")), config)
    lift = ((F.col("toxic") + 0.5) / (n[True] + 1)) / ((F.col("other") + 0.5) / (n[False] + 1))
    # at most a fixed number of terms come to the driver: those that separate best
    best = counted.filter(lift >= config.min_lift).orderBy((F.col("toxic") * F.log(lift)).desc(), "term").limit(20 * config.max_terms)
    terms = choose_terms([(r.term, r.toxic, r.other) for r in best.collect()], n[True], n[False], config)
    terms += [s for s in seeds if all(s[0] != t for t, _, _ in terms)]
    names = [f"f{i}" for i in range(len(FEATURES))]

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(terms)
        for batch in batches:
            x = np.array([features(t if isinstance(t, str) else None, lexicon, config) for t in batch["text"]]).reshape(-1, len(FEATURES))
            yield pd.DataFrame(x, columns=names).assign(y=batch["toxic"].to_numpy() > 0)

    table = rows.mapInPandas(featured, ", ".join(f"{c} double" for c in names) + ", y boolean").toPandas()
    table = table.sort_values(names + ["y"])  # sums in one order, whatever the partitions
    return Scorer(terms, *fit(table[names].to_numpy(float), table["y"].to_numpy(float)))


def score_documents(docs: DataFrame, scorer: Scorer, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted, hits, misspelled, quoted of every row."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(scorer.terms)
        for batch in batches:
            x = np.array([features(t if isinstance(t, str) else None, lexicon, config) for t in batch["text"]]).reshape(-1, len(FEATURES))
            s = scorer(x)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": s, "predicted": (s >= config.threshold).astype(np.int32), "exact_terms": x[:, 2].astype(np.int64), "quoted_hits": x[:, 6].astype(np.int64)})

    out = docs.select("doc_id", "text").mapInPandas(score, "doc_id long, score double, predicted int, exact_terms long, quoted_hits long")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "exact_terms", "quoted_hits")
