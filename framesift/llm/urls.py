"""URL filters: allow and block rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A rule (action, host, path) fits its host and every subdomain when the URL's path starts with the rule's; of the rules
that fit, the longest wins. A URL without a rule is blocked on one strict term or on several distinct soft terms; a term
counts only between boundaries (neighbours that are no letters or digits). Only ids and URLs are read, in Arrow batches;
rules and vocabulary travel with the function and are as small as the lists given.

Cases: null, empty or scheme-less URLs have empty host and path, no rule and no terms, so they are allowed; an empty
table gives an empty result; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: Rules as (action, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Terms, any of which blocks alone, and terms of which several distinct ones block.
STRICT = ("adult", "porn", "xxx", "casino", "viagra", "spam", "malware", "phishing", "warez", "escort", "hentai")
SOFT = ("cheap", "pills", "free", "win", "bet", "farm", "sex", "hot", "bets", "dating", "loan", "crack", "torrent", "pharmacy", "poker", "bonus", "discount", "replica", "nude", "cam", "gambling")


@dataclass(frozen=True)
class UrlConfig:
    rules: tuple[tuple[str, str, str], ...] = RULES
    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    #: Distinct soft terms that block together.
    min_soft: int = 2


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first "://", A-Z lower-cased; path up to "?" or "#"."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for end in "?#":
        rest = rest.partition(end)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def rule_for(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, action) of the longest rule that fits; rules by host."""
    best = None
    labels = host.split(".")
    for i in range(len(labels)):
        name = ".".join(labels[i:])
        for prefix, action in rules.get(name, ()):
            if path.startswith(prefix) and (best is None or len(name + prefix) > len(best[0])):
                best = (name + prefix, action)
    return best


SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_terms long, soft_terms long"


def judge_urls(pages: DataFrame, config: UrlConfig = UrlConfig(), *, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and how many distinct strict and soft terms the URL holds."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for kind, terms in (("strict", config.strict), ("soft", config.soft)):
            for term in terms:
                automaton.add_word(term, (kind, term))
        automaton.make_automaton()
        rules: dict[str, list[tuple[str, str]]] = {}
        for action, host, path in config.rules:
            rules.setdefault(host, []).append((path, action))

        def terms_of(url: str) -> tuple[int, int]:
            found: dict[str, set[str]] = {"strict": set(), "soft": set()}
            for end, (kind, term) in automaton.iter(url):
                start = end - len(term) + 1
                if (start == 0 or not url[start - 1].isalnum()) and (end + 1 == len(url) or not url[end + 1].isalnum()):
                    found[kind].add(term)
            return len(found["strict"]), len(found["soft"])

        for batch in batches:
            out = []
            for page, url in zip(batch[id_column], batch[url_column]):
                url = None if url is None or url != url else url
                host, path = split_url(url)
                strict, soft = terms_of(url.partition("://")[2].translate(_LOWER)) if host or path else (0, 0)
                rule = rule_for(host, path, rules)
                own = "block" if strict or soft >= config.min_soft else "allow"
                out.append((page, host, path, rule and rule[0], rule[1] if rule else own, strict, soft))
            yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms"]).astype({"page_id": "Int64"})

    return pages.select(id_column, url_column).mapInPandas(judge, SCHEMA)
