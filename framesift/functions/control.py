"""Conditions, formatted text, request variables, paths and errors as column expressions. Only false (and null) is false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def if_(test: Column, then, otherwise=None) -> Column:
    """IF, WHEN."""
    return F.when(test, _c(then)).otherwise(_c(otherwise))


def unless(test: Column, then) -> Column:
    """UNLESS."""
    return F.when(~F.coalesce(test, F.lit(False)), _c(then))


def cond(*clauses: tuple[Column, object], otherwise=None) -> Column:
    """COND: the first clause whose test holds."""
    return reduce(lambda out, c: F.when(c[0], _c(c[1])).otherwise(out), reversed(clauses), _c(otherwise))


def case(key: Column, *clauses: tuple[list, object], otherwise=None) -> Column:
    """CASE, QASE: membership of the key in each clause's list."""
    return cond(*((key.isin(*values), result) for values, result in clauses), otherwise=otherwise)


def and_(*tests: Column) -> Column:
    """AND."""
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def or_(*tests: Column) -> Column:
    """OR."""
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def not_(test: Column) -> Column:
    """NOT: true of false and of what is absent."""
    return ~F.coalesce(test, F.lit(False))


def values(**named) -> Column:
    """VALUES, MULTIPLE-VALUE-BIND: several results as one struct."""
    return F.struct(*(_c(v).alias(k) for k, v in named.items()))


def raise_exception(test: Column, message: str, value: Column) -> Column:
    """RAISE-EXCEPTION: the value, or an error of the job where the test holds."""
    return F.when(test, F.raise_error(F.lit(message)).cast("string")).otherwise(value)


def stringout(*parts) -> Column:
    """STRINGOUT, BUILD-STRING, PRINTOUT: parts as text, absent ones left out."""
    return F.concat(*(F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts))


def comma_list(items: Column, last: str = " and ") -> Column:
    """COMMA-LIST: "a, b and c"."""
    s = F.transform(items, lambda x: x.cast("string"))
    n = F.size(s)
    return F.when(n <= 1, F.array_join(s, "")).otherwise(F.concat(F.array_join(F.slice(s, F.lit(1), n - 1), ", "), F.lit(last), F.element_at(s, -1)))


def cgi_vars(query: Column) -> Column:
    """CGI-DATA, CGI-VAR: the variables of a query string as a map, decoded; the last of equal names counts."""
    pairs = F.transform(F.filter(F.split(query, "[&;]"), lambda p: p != ""), lambda p: F.struct(F.url_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), F.url_decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def basename(path: Column) -> Column:
    """BASENAME."""
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def dirname(path: Column) -> Column:
    """DIRNAME."""
    return F.regexp_replace(path, "/?[^/]*/*$", "")
