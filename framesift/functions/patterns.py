"""Structured text patterns, compiled to regular expressions of the JVM.

A pattern is a string (literal), a tuple or list (sequence), a set (alternatives), or one of the forms below. Matching
ignores case unless a ``match_case`` says otherwise. Alternatives that are literals are tried longest first, since the
matcher they stand for takes the longest extent at a start.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"\p{L}\p{Nd}"


@dataclass(frozen=True)
class Raw:
    """A piece of regular expression."""

    body: str


@dataclass(frozen=True)
class Form:
    kind: str
    args: tuple = field(default=())


def seq(*ps) -> tuple:
    return tuple(ps)


def alt(*ps) -> Form:
    return Form("alt", ps)


def star(p) -> Form:
    return Form("star", (p,))


def plus(p) -> Form:
    return Form("plus", (p,))


def not_(p) -> Form:
    """NOT: the text up to where p matches."""
    return Form("not", (p,))


def not_through(p) -> Form:
    """NOT>: the text up to and with the next match of p."""
    return Form("not>", (p,))


def and_(p, q) -> Form:
    """AND: both accept the same extent; for q the extent is what p takes first."""
    return Form("and", (p, q))


def label(name: str, p) -> Form:
    """LABEL and =."""
    return Form("label", (name, p))


def subst(p, new: str) -> Form:
    return Form("subst", (p, new))


def match_case(p) -> Form:
    """MATCH-CASE, MC."""
    return Form("flags", ("-i", p))


def ignore_case(p) -> Form:
    """IGNORE-CASE, IC."""
    return Form("flags", ("i", p))


def ignore_spacing(p) -> Form:
    """IGNORE-SPACING, IS: white space in literals stands for any run of it."""
    return Form("spacing", (p,))


def chunk(p) -> Form:
    return Form("chunk", (p,))


def word(p) -> Form:
    """WORD, PHRASE: between word bounds."""
    return Form("word", (p,))


def char_range(a: str, b: str) -> Raw:
    return Raw(f"[{re.escape(a)}-{re.escape(b)}]")


def char_not(chars: str) -> Raw:
    """CHAR-NOT: one or more characters that aren't listed."""
    return Raw(f"[^{re.escape(chars)}]+")


def char_not_star(chars: str) -> Raw:
    """CHAR-NOT*."""
    return Raw(f"[^{re.escape(chars)}]*")


REST, BOL, EOL = Raw(r"(?s:.*)"), Raw(r"(?m:^)"), Raw(r"(?m:$)")
SPACES, SPACES_STAR = Raw(r"\s+"), Raw(r"\s*")
ISSPACE, ISALNUM, ISALPHA, ISDIGIT = Raw(r"\s"), Raw(rf"[{WORDS}]"), Raw(r"\p{L}"), Raw(r"\p{Nd}")
ISWORD, ISPUNCT, ISCNTRL = Raw(rf"[{WORDS}_'-]"), Raw(r"\p{P}"), Raw(r"\p{Cc}")
ISUPPER, ISLOWER = Raw(r"(?-i:\p{Lu})"), Raw(r"(?-i:\p{Ll})")
LSYMBOL, CSYMBOL = Raw(r"[^\s()\"'`;,]+"), Raw(r"[A-Za-z_][A-Za-z0-9_]*")
XMLNAME, XMLNMTOKEN = Raw(r"[A-Za-z_:][\w.:-]*"), Raw(r"[\w.:-]+")
AWORD, LWORD, ANUMBER = Raw(r"\p{L}+"), Raw(r"(?-i:\p{Ll}+)"), Raw(r"[-+]?\p{Nd}+(?:[.,]\p{Nd}+)*")
CAPWORD, COMPOUND_WORD, MAILID = Raw(r"(?-i:\p{Lu}[\p{L}'-]*)"), Raw(r"\p{L}+(?:[-_/']\p{L}+)*"), Raw(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*")


def one_or_more(p: Raw) -> Raw:
    """ISSPACE+, ISALNUM+, ISALPHA+, ISDIGIT+, ISWORD+, ISPUNCT+, ISCNTRL+, ISUPPER+, ISLOWER+: a maximal run."""
    return Raw(f"(?:{p.body})++")


def compile_pattern(p, spacing: bool = False) -> str:
    """TX-CLOSURE: the regular expression of a pattern, without flags."""
    go = lambda x: compile_pattern(x, spacing)
    if isinstance(p, Raw):
        return p.body
    if isinstance(p, str):
        if spacing:
            return r"\s+".join(_literal(x) for x in re.split(r"\s+", p))
        return _literal(p)
    if isinstance(p, (tuple, list)):
        return "".join(map(go, p))
    if isinstance(p, (set, frozenset)):
        return go(Form("alt", tuple(p)))
    kind, args = p.kind, p.args
    if kind == "alt":
        parts = sorted(map(go, args), key=lambda x: (-len(x), x)) if all(isinstance(a, str) for a in args) else list(map(go, args))
        return f"(?:{'|'.join(parts)})"
    if kind in ("star", "plus"):
        return f"(?:{go(args[0])}){'*' if kind == 'star' else '+'}"
    if kind == "not":
        return f"(?s:(?!{go(args[0])}).)+"
    if kind == "not>":
        return f"(?s:(?!{go(args[0])}).)*{go(args[0])}"
    if kind == "and":
        return f"(?=(?:{go(args[1])}))(?:{go(args[0])})"
    if kind == "label":
        return f"(?<{args[0]}>{go(args[1])})"
    if kind == "subst":
        return f"(?:{go(args[0])})"
    if kind == "flags":
        return f"(?{args[0]}:{go(args[1])})"
    if kind == "spacing":
        return compile_pattern(args[0], True)
    if kind == "chunk":
        return f"(?>{go(args[0])})"
    if kind == "word":
        return rf"(?<![{WORDS}]){go(args[0])}(?![{WORDS}])"
    raise ValueError(f"no such pattern: {kind}")


def _literal(s: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|\-#&~])", r"\\\1", s)


def labels(p) -> list[str]:
    if isinstance(p, (tuple, list, set, frozenset)):
        return [x for q in p for x in labels(q)]
    if isinstance(p, Form):
        own = [p.args[0]] if p.kind == "label" else []
        return own + [x for q in p.args if not isinstance(q, str) for x in labels(q)]
    return []


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _regex(p) -> str:
    return f"(?i){compile_pattern(p)}"


def tx_match(p, s) -> Column:
    """TX-MATCH: the whole string."""
    return _c(s).rlike(rf"(?i)\A(?:{compile_pattern(p)})\z")


def tx_search(p, s) -> Column:
    """TX-SEARCH: offset of the first match, from 0; null if there is none."""
    return F.nullif(F.regexp_instr(_c(s), F.lit(_regex(p))) - 1, F.lit(-1))


def tx_matcher(p, s) -> Column:
    """TX-MATCHER at offset 0: the end of the longest match there; null if there is none."""
    return F.when(_c(s).rlike(rf"(?i)\A(?:{compile_pattern(p)})"), F.length(F.regexp_extract(_c(s), rf"(?i)\A(?:{compile_pattern(p)})", 0)))


def tx_matcher_ends(p, s) -> Column:
    """All ends of matches at offset 0: the set-valued form, for which every prefix is tried."""
    body = compile_pattern(p)

    @F.pandas_udf("array<int>")
    def ends(x: pd.Series) -> pd.Series:
        import regex

        r = regex.compile(body, regex.I)
        return x.map(lambda v: [] if v is None else [e for e in range(len(v) + 1) if r.fullmatch(v, 0, e)])

    return ends(_c(s))


def tx_extract(p, s) -> Column:
    """TX-EXTRACT, TEXTLET, MATCH->FRAME: the labelled parts of a whole match, as a struct; null where it doesn't match."""
    names = labels(p)
    whole = rf"(?i)\A(?:{compile_pattern(p)})\z"
    order = re.findall(r"\((?:\?<([A-Za-z]\w*)>|(?!\?))", re.sub(r"\\.", "", whole))
    found = F.struct(*(F.nullif(F.regexp_extract(_c(s), whole, order.index(n) + 1), F.lit("")).alias(n) for n in names))
    return F.when(_c(s).rlike(whole), found)


def tx_subst(p, s) -> Column:
    """TX-SUBST: every match of a pattern with a ``subst`` inside is rewritten."""
    parts = p if isinstance(p, (tuple, list)) else (p,)
    body, new, group = "", "", 0
    for part in parts:
        if isinstance(part, Form) and part.kind == "subst":
            body += compile_pattern(part)
            new += re.sub(r"([\\$])", r"\\\1", part.args[1])
        else:
            group += 1
            body += f"({re.sub(r'[(][?]<[A-Za-z]' + chr(92) + 'w*>', '(?:', compile_pattern(part))})"
            new += f"${group}"
    return F.regexp_replace(_c(s), f"(?i){body}", new)


def gather(p, s) -> Column:
    """GATHER, TX-GATHER: the set of matched substrings."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(s), F.lit(_regex(p)), F.lit(0))))


def segment(s, p=None) -> Column:
    """SEGMENT, TX-SEGMENT: the pieces between matches; without a pattern, the runs of letters and digits."""
    if p is None:
        return F.regexp_extract_all(_c(s), F.lit(f"[{WORDS}]+"), F.lit(0))
    return F.filter(F.split(_c(s), _regex(p)), lambda x: x != "")


def csegment(s) -> Column:
    """CSEGMENT: tokens that may hold '-', '/' and '_'."""
    return F.regexp_extract_all(_c(s), F.lit(rf"[{WORDS}\-/_]+"), F.lit(0))


def fragment(s, p=None) -> Column:
    """FRAGMENT, TX-FRAGMENT: text and separators in turn."""
    sep = f"[^{WORDS}]+" if p is None else _regex(p)
    return F.regexp_extract_all(_c(s), F.lit(rf"(?s)(?:{sep})|(?:(?!{sep}).)+"), F.lit(0))


def canonical(s) -> Column:
    """CANONICAL, IGNORE-DIACRITICS, IGNORE-SPACING, ID: a text as patterns see it that ignore case, accents and spacing;
    match against it what has gone through it too. Without it accents and spacing count (MATCH-DIACRITICS, MD, MATCH-SPACING, MS)."""
    from .strings import std_string

    return std_string(s)


def in_hashset(tokens, words) -> Column:
    """HASHSET as a pattern: the tokens that are in a small list of words; HASHSET-NOT keeps the others. For large sets
    explode the tokens and use ``operators.tables.accept`` and ``filter_``."""
    return F.filter(_c(tokens), lambda x: x.isin(*words))


def not_in_hashset(tokens, words) -> Column:
    """HASHSET-NOT."""
    return F.filter(_c(tokens), lambda x: ~x.isin(*words))
