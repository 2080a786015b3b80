"""English text: Porter stems, proper names, time expressions. Python in Arrow batches, since these are state machines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_STEPS2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEPS3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEPS4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """c and v for every letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return len(w) >= 3 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def porter(word: str) -> str:
    """The stem of an English word by Porter's published algorithm (1980). Words that aren't a-z come back unchanged."""
    w = word.lower()
    if len(w) <= 2 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for steps in (_STEPS2, _STEPS3):
        for suffix, to in sorted(steps, key=lambda s: -len(s[0])):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + to
                break
    for suffix in sorted(_STEPS4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def english_stem(s: pd.Series) -> pd.Series:
    """ENGLISH-STEM."""
    return s.map(lambda x: None if x is None else porter(x))


#: Own defaults, all of them parameters: titles of civil life, learning, church, office and arms, which don't end a name;
#: English function words by their kind, which begin none; and suffixes that belong to one.
TITLES = ("Mr.", "Mrs.", "Ms.", "Mx.", "Miss", "Sir", "Dr.", "Prof.", "Rev.", "Fr.", "St.", "Hon.", "Pres.", "Gov.", "Sen.", "Rep.", "Amb.", "Gen.", "Col.", "Maj.", "Capt.", "Lt.", "Sgt.", "Cpl.", "Adm.", "Cmdr.")
_ARTICLES = "the a an this that these those some any each every no all both either neither such another"
_PRONOUNS = "i you he she it we they me him her us them my your his its our their mine yours hers ours theirs who whom whose which what"
_PREPOSITIONS = "about above across after against along among around as at before behind below beneath beside between beyond by despite down during except for from in inside into like near of off on onto out outside over past since through throughout till to toward under until up upon with within without"
_CONJUNCTIONS = "and or but nor so yet if because although though unless while whereas whether when whenever where wherever why how than then once"
_ADVERBS = "also again already always even ever here however indeed instead just maybe meanwhile moreover never not often only otherwise perhaps quite rather really sometimes soon still there therefore thus too very well yes"
STOPS = tuple(sorted({w.capitalize() for w in f"{_ARTICLES} {_PRONOUNS} {_PREPOSITIONS} {_CONJUNCTIONS} {_ADVERBS}".split()}))
SUFFIXES = ("Jr.", "Sr.", "II", "III", "Inc.", "Ltd.", "Corp.")


def names_in(text: str, titles=TITLES, stops=STOPS, suffixes=SUFFIXES) -> list[str]:
    """Runs of capitalised words; a stop word or the end of a sentence ends a run, a title doesn't, but starts a new one."""
    found, run = set(), []

    def done() -> None:
        if run:
            found.add(" ".join(run))
            run.clear()

    for token in text.split():
        bare = token.rstrip(",;:!?)\"'").lstrip("(\"'")
        word = bare if bare in titles or bare in suffixes else bare.rstrip(".")
        starts = bool(word) and (word[0].isupper() or (word[0].isdigit() and bool(run)))
        if not starts or word in stops:
            done()
            continue
        if word in titles and run and run[-1] not in titles:
            done()
        run.append(word)
        if word not in titles and (token[-1] in ".,;:!?)\"'" and word != token):
            done()
    done()
    return sorted(found)


def get_names(s, titles=TITLES, stops=STOPS, suffixes=SUFFIXES) -> Column:
    """GET-NAMES, REFPOINTS; the lists are parameters (ADD-ABBREV!, ADD-REFSTOP!)."""

    @F.pandas_udf("array<string>")
    def names(x: pd.Series) -> pd.Series:
        return x.map(lambda v: [] if v is None else names_in(v, titles, stops, suffixes))

    return names(F.col(s) if isinstance(s, str) else s)


_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DAY = r"(?:(?:mon|tues|wednes|thurs|fri|satur|sun)day)"
TIMES = rf"(?i)\b(?:\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?:\s*[ap]m\b)?|\d{{1,2}}\s*[ap]m\b|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}(?:/\d{{2,4}})?|{_MONTH}\s+\d{{1,2}}(?:,\s*\d{{4}})?|\d{{1,2}}\s+{_MONTH}(?:\s+\d{{4}})?|{_DAY}|{_MONTH}\b|noon|midnight|today|tomorrow|yesterday)"


def get_times(s) -> Column:
    """GET-TIMES: the set of time expressions, by one pattern, inside the JVM."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(s) if isinstance(s, str) else s, F.lit(TIMES), F.lit(0))))
