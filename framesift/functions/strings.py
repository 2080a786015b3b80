"""Strings and characters. Unicode classes are those of Java regular expressions unless said otherwise."""

from __future__ import annotations

import html as _html
import unicodedata
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ALNUM = r"\p{L}\p{Nd}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def string_length(s) -> Column:
    return F.length(_c(s))


def substring(s, start, end=None) -> Column:
    """SUBSTRING, SUBSEQ on strings: half-open, from 0."""
    start = start if isinstance(start, Column) else F.lit(start)
    end = F.length(_c(s)) if end is None else end if isinstance(end, Column) else F.lit(end)
    return F.substring(_c(s), start + 1, F.greatest(end - start, F.lit(0)))


def string_append(*xs) -> Column:
    return F.concat(*map(_c, xs))


def space_append(spacer: str, *xs) -> Column:
    return F.concat_ws(spacer, *map(_c, xs))


def make_string(size: int, init: str = " ") -> Column:
    return F.repeat(F.lit(init), size)


def string_ref(s, k) -> Column:
    return F.substring(_c(s), (k if isinstance(k, Column) else F.lit(k)) + 1, F.lit(1))


def string_set(s, k: int, c: str) -> Column:
    return F.overlay(_c(s), F.lit(c), F.lit(k + 1), F.lit(1))


def string_fill(s, c: str) -> Column:
    return F.repeat(F.lit(c), F.length(_c(s)))


def string_to_list(s) -> Column:
    return F.filter(F.split(_c(s), ""), lambda x: x != "")


def list_to_string(a) -> Column:
    return F.array_join(_c(a), "")


def string_compare(op: str, a, b, ci: bool = False) -> Column:
    """STRING=?, STRING<?, STRING>?, STRING<=?, STRING>=?, STRING-CI=?, STRING-CI<?, STRING-CI>?, STRING-CI<=?, STRING-CI>=?,
    and CHAR=?, CHAR<?, CHAR>?, CHAR<=?, CHAR>=?, CHAR-CI=?, CHAR-CI<?, CHAR-CI>?, CHAR-CI<=?, CHAR-CI>=?: ordinary order by code point (not the total order of sets)."""
    x, y = (F.lower(_c(a)), F.lower(_c(b))) if ci else (_c(a), _c(b))
    return {"=": x == y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def string_contains(s, part) -> Column:
    return F.contains(_c(s), part if isinstance(part, Column) else F.lit(part))


def has_prefix(prefix, s) -> Column:
    return _c(s).startswith(prefix)


def has_suffix(suffix, s) -> Column:
    return _c(s).endswith(suffix)


def string_upcase(s) -> Column:
    """STRING-UPCASE, CHAR-UPCASE."""
    return F.upper(_c(s))


def string_downcase(s) -> Column:
    """STRING-DOWNCASE, CHAR-DOWNCASE."""
    return F.lower(_c(s))


def string_capitalize(s) -> Column:
    """A word starts after white space or punctuation, except after an apostrophe."""
    chars = F.filter(F.split(F.lower(_c(s)), ""), lambda x: x != "")
    start = lambda prev: prev.rlike(r"^[\s\p{Punct}\p{P}]$") & (prev != "'")
    return F.aggregate(
        chars, F.struct(F.lit("").alias("out"), F.lit(True).alias("up")),
        lambda a, x: F.struct(F.concat(a["out"], F.when(a["up"], F.upper(x)).otherwise(x)).alias("out"), start(x).alias("up")),
        lambda a: a["out"],
    )


def string_trim(s) -> Column:
    return F.regexp_replace(_c(s), r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def string_base(s: pd.Series) -> pd.Series:
    """STRING-BASE, CHAR-BASE: without diacritics."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


def string_lower_base(s) -> Column:
    """STRING-LOWER-BASE, CHAR-LOWER-BASE."""
    return F.lower(string_base(_c(s)))


def is_valid_utf8(b) -> Column:
    return F.is_valid_utf8(_c(b))


def patch_utf8(b) -> Column:
    return F.make_valid_utf8(_c(b))


def string_subst(s, old: str, new: str) -> Column:
    """Every literal occurrence; an empty key is an error."""
    if not old:
        raise ValueError("the search key is empty")
    return F.replace(_c(s), F.lit(old), F.lit(new))


def is_empty_string(s) -> Column:
    return F.length(_c(s)) == 0


def is_lowercase(s) -> Column:
    """No upper-case letter."""
    return ~_c(s).rlike(r"\p{Lu}")


def is_uppercase(s) -> Column:
    return ~_c(s).rlike(r"\p{Ll}")


def is_numeric(s) -> Column:
    """All digits; true of the empty string."""
    return _c(s).rlike(r"^\p{Nd}*$")


def is_capitalized(s) -> Column:
    return _c(s).rlike(r"^\p{Lu}")


def is_multi_line(s) -> Column:
    return F.contains(_c(s), F.lit("\n"))


def _percent(s: Column, kept: str) -> Column:
    n = F.length(s)
    return F.when(n == 0, F.lit(0)).otherwise(F.floor(100 * (n - F.length(F.regexp_replace(s, f"[{kept}]", ""))) / F.nullif(n, F.lit(0)))).cast("int")


def whitespace_percent(s) -> Column:
    """Whole percentage of white space; a tab counts four times, '<' counts once and takes its next character along."""
    t = _c(s)
    seen = F.regexp_replace(t, r"(?s)<.", "<")
    n = F.length(seen)
    space = n - F.length(F.regexp_replace(seen, r"[\s<]", "")) + 3 * (n - F.length(F.regexp_replace(seen, r"\t", "")))
    return F.when(n == 0, F.lit(0)).otherwise(F.floor(100 * space / F.nullif(n, F.lit(0)))).cast("int")


def alphabetic_percent(s) -> Column:
    return _percent(_c(s), r"\p{L}")


def alphanumeric_percent(s) -> Column:
    return _percent(_c(s), ALNUM)


def std_space(s) -> Column:
    """STDSPACE: runs of white space become one space, none at either end."""
    return F.regexp_replace(F.regexp_replace(_c(s), r"^\s+|\s+$", ""), r"\s+", " ")


def std_string(s) -> Column:
    """STDSTRING: STDSPACE, lower case, base characters."""
    return string_lower_base(std_space(s))


def _ngrams(s: Column, n: int) -> Column:
    chars = F.filter(F.split(F.lower(s), ""), lambda x: x != "")
    grams = F.transform(chars, lambda x, i: F.concat(x, *(F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(1, n))))
    return F.array_sort(F.array_distinct(F.filter(grams, lambda g: F.length(g) == n)))


def get_bigrams(s) -> Column:
    """GET-BIGRAMS: the set of character pairs, lower-cased."""
    return F.transform(F.array(_c(s)), lambda t: _ngrams_of(t, 2))[0]


def get_trigrams(s) -> Column:
    return F.transform(F.array(_c(s)), lambda t: _ngrams_of(t, 3))[0]


def _ngrams_of(t: Column, n: int) -> Column:
    low = F.lower(t)
    places = F.when(F.length(low) >= n, F.sequence(F.lit(1), F.length(low) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(n)))))


def strip_margin(s) -> Column:
    """STRIP-MARGIN: in every run of characters that are no letters or digits only the first stays; none at the start."""
    return F.regexp_replace(F.regexp_replace(_c(s), f"^[^{ALNUM}]+", ""), f"([^{ALNUM}])[^{ALNUM}]+", "$1")


def columnize(s, cols: list[int]) -> Column:
    """COLUMNIZE: cut fixed-width text at 1-based columns."""
    ends = [*cols[1:], None]
    return F.array(*(F.substring(_c(s), F.lit(a), F.lit(2**31 - 1 if b is None else b - a)) for a, b in zip(cols, ends)))


def suffix_rule(s, rules: list[tuple[str, str]]) -> Column:
    """SUFFIXRULE: candidate roots by replacing suffixes; keep those of a root table with a semi join."""
    t = _c(s)
    found = [F.when(t.endswith(a) & (F.length(t) > len(a)), F.concat(F.substring(t, F.lit(1), F.length(t) - len(a)), F.lit(b))) for a, b in rules]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def morph_rule(s, rules: list[tuple[str, str]]) -> Column:
    """MORPHRULE: candidate roots by whole-string rewrites (pattern, replacement)."""
    t = _c(s)
    found = [F.when(t.rlike(f"^(?:{a})$"), F.regexp_replace(t, f"^(?:{a})$", b)) for a, b in rules]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def char_class(name: str, c) -> Column:
    """CHAR-ALPHABETIC?, CHAR-ALPHANUMERIC?, CHAR-NUMERIC?, CHAR-WHITESPACE?, CHAR-UPPER-CASE?, CHAR-LOWER-CASE?."""
    body = {"alphabetic": r"\p{L}", "alphanumeric": f"[{ALNUM}]", "numeric": r"\p{Nd}", "whitespace": r"\s", "upper-case": r"\p{Lu}", "lower-case": r"\p{Ll}"}[name]
    return _c(c).rlike(f"^{body}$")


def char_to_integer(c) -> Column:
    return F.ascii(_c(c))


def integer_to_char(i) -> Column:
    """Any code point: through UTF-32."""
    return F.decode(F.unhex(F.lpad(F.hex(_c(i)), 8, "0")), "UTF-32")


def packet(*values: int) -> Column:
    return F.unhex(F.lit("".join(f"{v:02X}" for v in values)))


def string_to_packet(s, encoding: str = "UTF-8") -> Column:
    return F.encode(_c(s), encoding)


def packet_to_string(b, encoding: str = "UTF-8") -> Column:
    return F.decode(_c(b), encoding)


def packet_to_vector(b) -> Column:
    h = F.hex(_c(b))
    places = F.when(F.length(h) > 0, F.sequence(F.lit(1), F.length(h), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("int"))


def vector_to_packet(a) -> Column:
    return F.unhex(F.array_join(F.transform(_c(a), lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def packet_ref(b, i: int) -> Column:
    return F.conv(F.substring(F.hex(_c(b)), 2 * i + 1, 2), 16, 10).cast("int")


def uint_to_packet(x, width: int = 4) -> Column:
    return F.unhex(F.lpad(F.hex(_c(x)), 2 * width, "0"))


def packet_to_uint(b) -> Column:
    return F.conv(F.hex(_c(b)), 16, 10).cast("long")


def uri_decode(s) -> Column:
    @F.pandas_udf("string")
    def decode(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else unquote(v))

    return decode(_c(s))


def uri_encode(s) -> Column:
    @F.pandas_udf("string")
    def encode(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else quote(v, safe=""))

    return encode(_c(s))


def convert_entities(s) -> Column:
    """CONVERT-CHARACTER-ENTITIES."""

    @F.pandas_udf("string")
    def convert(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else _html.unescape(v))

    return convert(_c(s))


def hash_value(x) -> Column:
    """HASH-LISP, HASH-DTYPE, HASH-DTYPE2, HASH-DTYPE3: a portable structural hash (values are this engine's own)."""
    return F.xxhash64(_c(x))


def md5(s) -> Column:
    return F.md5(_c(s))


def get_mail_ids(s) -> Column:
    """GET-MAILIDS: the set of mail and message ids."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(s), F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z0-9]"), F.lit(0))))


def packet_set(b, i: int, value: int) -> Column:
    """PACKET-SET!: a changed copy."""
    h = F.hex(_c(b))
    return F.unhex(F.overlay(h, F.lit(f"{value:02X}"), 2 * i + 1, 2))


def symbol(s) -> Column:
    """STRING->SYMBOL, INTERN: names are upper-cased strings; SYMBOL->STRING gives them back."""
    return F.upper(_c(s))


def string_copy(s) -> Column:
    """STRING-COPY, QSTRING, ZSTRING, COPY-LISP: values don't change, so a copy is the value."""
    return _c(s)
