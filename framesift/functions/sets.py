"""Choices (sets) as array columns. A null array is the empty set; null elements are absent.

Results are sets: without repeats, sorted where an order shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def proper_choice(s: Column | str) -> Column:
    """PROPER-CHOICE, QUOTED-CHOICE, QC: the set kept whole in one value."""
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(_c(s), F.array()))))


def is_proper_choice(s: Column | str) -> Column:
    """PROPER-CHOICE?: no repeats and no nulls."""
    return F.size(F.array_distinct(F.array_compact(_c(s)))) == F.size(_c(s))


def choice(*sets: Column | str) -> Column:
    """CHOICE, AMB, EITHER, UNION."""
    return proper_choice(F.flatten(F.array(*(F.coalesce(_c(s), F.array()) for s in sets))))


def fail(kind: str = "string") -> Column:
    """FAIL: the empty set."""
    return F.array().cast(f"array<{kind}>")


def intersection(first: Column | str, *rest: Column | str) -> Column:
    out = proper_choice(first)
    for r in rest:
        out = F.array_intersect(out, proper_choice(r))
    return F.array_sort(out)


def difference(first: Column | str, *rest: Column | str) -> Column:
    out = proper_choice(first)
    for r in rest:
        out = F.array_except(out, proper_choice(r))
    return F.array_sort(out)


def try_(*sets: Column | str) -> Column:
    """TRY: the first alternative that is not empty."""
    out = proper_choice(sets[-1])
    for s in reversed(sets[:-1]):
        out = F.when(choice_size(s) > 0, proper_choice(s)).otherwise(out)
    return out


def identical(a: Column | str, b: Column | str) -> Column:
    return proper_choice(a) == proper_choice(b)


def contains(a: Column | str, b: Column | str) -> Column:
    """CONTAINS?: every element of a is in b."""
    return F.size(F.array_except(proper_choice(a), proper_choice(b))) == 0


def overlaps(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_intersect(proper_choice(a), proper_choice(b))) > 0


def choice_size(s: Column | str) -> Column:
    """CHOICE-SIZE, SET-SIZE."""
    return F.size(proper_choice(s))


def is_empty(s: Column | str) -> Column:
    """EMPTY?, FAIL?."""
    return choice_size(s) == 0


def exists(s: Column | str) -> Column:
    """EXISTS?."""
    return choice_size(s) > 0


def satisfied(value: Column | str) -> Column:
    """SATISFIED?: neither empty nor false."""
    return F.coalesce(_c(value), F.lit(False))


def exists_where(s: Column | str, *tests: Callable[[Column], Column]) -> Column:
    """EXISTS as a form: some element passes every test."""
    return F.size(filter_choices(s, *tests)) > 0


def filter_choices(s: Column | str, *tests: Callable[[Column], Column]) -> Column:
    out = proper_choice(s)
    for t in tests:
        out = F.filter(out, t)
    return out


def count_choices(s: Column | str, *tests: Callable[[Column], Column]) -> Column:
    return F.size(filter_choices(s, *tests))


def for_choices(s: Column | str, body: Callable[[Column], Column]) -> Column:
    """FOR-CHOICES: map and take the union; the body gives one value each."""
    return proper_choice(F.transform(proper_choice(s), body))


def for_choices_flat(s: Column | str, body: Callable[[Column], Column]) -> Column:
    """FOR-CHOICES with a body that gives sets."""
    return proper_choice(F.flatten(F.transform(proper_choice(s), body)))


def is_singleton(s: Column | str) -> Column:
    return choice_size(s) == 1


def singleton(s: Column | str) -> Column:
    """SINGLETON: the element if there is one only, else nothing."""
    p = proper_choice(s)
    return F.when(F.size(p) == 1, F.get(p, F.lit(0)))


def smallest(s: Column | str, key: Callable[[Column], Column] | None = None) -> Column:
    """SMALLEST: all elements whose key is least."""
    p = proper_choice(s)
    if key is None:
        return F.slice(p, 1, 1)
    return F.filter(p, lambda x: key(x) == F.array_min(F.transform(p, key)))


def largest(s: Column | str, key: Callable[[Column], Column] | None = None) -> Column:
    p = proper_choice(s)
    if key is None:
        return F.slice(F.reverse(p), 1, 1)
    return F.filter(p, lambda x: key(x) == F.array_max(F.transform(p, key)))


def sorted_by(s: Column | str, key: Callable[[Column], Column] | None = None) -> Column:
    """SORTED, SORTBY: a vector in order of a key, ties by the element."""
    p = proper_choice(s)
    if key is None:
        return p
    return F.transform(F.array_sort(F.transform(p, lambda x: F.struct(key(x).alias("k"), x.alias("x")))), lambda t: t["x"])


def choices_to_vector(s: Column | str) -> Column:
    """CHOICES->VECTOR, CHOICES->LIST, CHOICE->LIST, SORTED-CHOICE."""
    return proper_choice(s)


def elements(seq: Column | str) -> Column:
    """ELEMENTS, ELTS, SEQ->CHOICE, SEQ->CHOICES, SEQ->SET, LIST->CHOICES, LIST->SET."""
    return proper_choice(seq)


def is_one_of(value: Column | str, *candidates) -> Column:
    """IS-ONE-OF?."""
    return F.coalesce(_c(value).isin(*candidates), F.lit(False))


def log_ior(x: Column | str, y: Column | str) -> Column:
    """%LOGIOR."""
    return _c(x).bitwiseOR(_c(y))


def log_and(x: Column | str, y: Column | str) -> Column:
    """%LOGAND."""
    return _c(x).bitwiseAND(_c(y))


def log_xor(x: Column | str, y: Column | str) -> Column:
    """%LOGXOR."""
    return _c(x).bitwiseXOR(_c(y))


def any_greater(s: Column | str, than: Column) -> Column:
    """ANY>?: whether some element is greater; false for the empty set."""
    return F.coalesce(F.exists(_c(s), lambda x: F.coalesce(x > than, F.lit(False))), F.lit(False))


def any_less(s: Column | str, than: Column) -> Column:
    """ANY<?: whether some element is less; false for the empty set."""
    return F.coalesce(F.exists(_c(s), lambda x: F.coalesce(x < than, F.lit(False))), F.lit(False))
