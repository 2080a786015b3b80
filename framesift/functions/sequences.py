"""Vectors and lists as array columns, pairs and records as structs, association lists as maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def elt(a, i: int) -> Column:
    """ELT, VECTOR-REF, LIST-REF, from 0; null outside."""
    return F.get(_c(a), F.lit(i))


def first(a) -> Column:
    return elt(a, 0)


def second(a) -> Column:
    return elt(a, 1)


def third(a) -> Column:
    return elt(a, 2)


def find(item, a) -> Column:
    """FIND, CL-FIND, MEMBER?."""
    return F.coalesce(F.array_contains(_c(a), item), F.lit(False))


def position(item, a) -> Column:
    """POSITION, CL-POSITION: from 0; null if absent."""
    return F.nullif(F.array_position(_c(a), item), F.lit(0)) - 1


def search(part, a) -> Column:
    """SEARCH, CL-SEARCH: where a sub-sequence starts, from 0; null if absent."""
    p, s = _c(part), _c(a)
    starts = F.when(F.size(s) >= F.size(p), F.sequence(F.lit(0), F.size(s) - F.size(p))).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(starts, lambda i: F.slice(s, i + 1, F.size(p)) == p), F.lit(0))


def mismatch(a, b) -> Column:
    """MISMATCH, CL-MISMATCH: the first place where two sequences differ; null if they don't."""
    x, y = _c(a), _c(b)
    differ = F.filter(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y))), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)) | ((i < F.size(x)) != (i < F.size(y))))
    return F.get(differ, F.lit(0))


def count(item, a) -> Column:
    """COUNT, CL-COUNT."""
    return F.size(F.filter(_c(a), lambda x: x == item))


def remove(item, a) -> Column:
    return F.array_remove(_c(a), item)


def reverse(a) -> Column:
    return F.reverse(_c(a))


def every(test: Callable[[Column], Column], a) -> Column:
    """EVERY?: whether all elements pass; true for the empty sequence."""
    return F.forall(_c(a), lambda x: F.coalesce(test(x), F.lit(False)))


def some(test: Callable[[Column], Column], a) -> Column:
    """SOME?: whether some element passes; false for the empty sequence."""
    return F.exists(_c(a), lambda x: F.coalesce(test(x), F.lit(False)))


def map_(body: Callable[[Column], Column], a) -> Column:
    """MAP, FOR-EACH, DOSEQ, DOLIST."""
    return F.transform(_c(a), body)


def map2(body: Callable[[Column, Column], Column], a, b) -> Column:
    """MAP over two lists; as long as the shorter."""
    x, y = _c(a), _c(b)
    n = F.least(F.size(x), F.size(y))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), body)


def dotimes(n: int, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), body) if n > 0 else F.array()


def vector(*xs) -> Column:
    return F.array(*map(_c, xs))


def make_vector(size: int, init) -> Column:
    return F.array_repeat(init if isinstance(init, Column) else F.lit(init), size)


def vector_length(a) -> Column:
    return F.size(_c(a))


def set_elt(a, i: int, value) -> Column:
    """VECTOR-SET!, VECTOR-SUBST, SET-ELT!: a changed copy."""
    return F.transform(_c(a), lambda x, k: F.when(k == i, value if isinstance(value, Column) else F.lit(value)).otherwise(x))


def vector_fill(a, value) -> Column:
    return F.transform(_c(a), lambda x: F.lit(value))


def append(*xs) -> Column:
    return F.concat(*map(_c, xs))


def cons(head, a) -> Column:
    return F.array_prepend(_c(a), head)


def list_tail(a, i: int) -> Column:
    return F.slice(_c(a), F.lit(i + 1), F.greatest(F.size(_c(a)) - i, F.lit(0)))


def subseq(a, start: int, end: int | None = None) -> Column:
    """SUBSEQ on vectors: half-open, from 0."""
    n = F.size(_c(a)) if end is None else F.least(F.lit(end), F.size(_c(a)))
    return F.slice(_c(a), F.lit(start + 1), F.greatest(n - start, F.lit(0)))


def typed_vector(kind: str, *xs) -> Column:
    """INT-VECTOR, SHORT-VECTOR, FLOAT-VECTOR, DOUBLE-VECTOR."""
    return F.array(*map(_c, xs)).cast(f"array<{kind}>")


def car(pair: Column) -> Column:
    return pair.getField("car")


def cdr(pair: Column) -> Column:
    return pair.getField("cdr")


def pair(a, b) -> Column:
    return F.struct(_c(a).alias("car"), _c(b).alias("cdr"))


def assoc(key, m) -> Column:
    """ASSOC, ASSQ, ASSV on a map; null if absent."""
    return F.try_element_at(_c(m), key if isinstance(key, Column) else F.lit(key))


def sort_by_car(a) -> Column:
    """SORTCAR: pairs in order of their first component."""
    return F.array_sort(_c(a))


def make_record(tag: str, data) -> Column:
    return F.struct(F.lit(tag).alias("tag"), _c(data).alias("data"))


def record_tag(r: Column) -> Column:
    return r["tag"]


def record_data(r: Column, tag: str | None = None) -> Column:
    """Null where the tag is another."""
    return r["data"] if tag is None else F.when(r["tag"] == tag, r["data"])


def fourth(a) -> Column:
    return elt(a, 3)


def fifth(a) -> Column:
    return elt(a, 4)


def length(a) -> Column:
    """LENGTH."""
    return F.size(_c(a))


def list_(*xs) -> Column:
    """LIST, LIST->VECTOR, VECTOR->LIST: lists and vectors are both arrays."""
    return F.array(*map(_c, xs))


def list_star(*xs) -> Column:
    """LIST*: the last argument is the tail."""
    return F.concat(F.array(*map(_c, xs[:-1])), _c(xs[-1]))


def member(item, a) -> Column:
    """MEMBER, MEMQ, MEMV: the tail from the first occurrence on; null if absent."""
    at = F.array_position(_c(a), item)
    return F.when(at > 0, F.slice(_c(a), at.cast("int"), F.size(_c(a))))


def set_car(pair: Column, value) -> Column:
    """SET-CAR!: a changed copy."""
    return pair.withField("car", value if isinstance(value, Column) else F.lit(value))


def set_cdr(pair: Column, value) -> Column:
    """SET-CDR!: a changed copy."""
    return pair.withField("cdr", value if isinstance(value, Column) else F.lit(value))


def make_typed_vector(kind: str, size: int, init=0) -> Column:
    """MAKE-INT-VECTOR, MAKE-SHORT-VECTOR, MAKE-FLOAT-VECTOR, MAKE-DOUBLE-VECTOR."""
    return F.array_repeat(F.lit(init), size).cast(f"array<{kind}>")


def _is(x, *starts: str) -> Column:
    from functools import reduce

    c = _c(x)
    return c.isNotNull() & reduce(lambda a, b: a | b, (F.typeof(c).startswith(s) for s in starts))


def is_null(x) -> Column:
    """NULL?, VOID?: absent."""
    return _c(x).isNull()


def is_vector(x) -> Column:
    """VECTOR?, LIST?, SEQUENCE?."""
    return _is(x, "array")


def is_string(x) -> Column:
    """STRING?, SYMBOL?, CHARACTER?."""
    return _is(x, "string")


def is_boolean(x) -> Column:
    return _is(x, "boolean")


def is_packet(x) -> Column:
    return _is(x, "binary")


def is_pair(x) -> Column:
    return _is(x, "struct<car:")


def is_record(x) -> Column:
    return _is(x, "struct<tag:")


def is_slotmap(x) -> Column:
    return _is(x, "map", "struct")
