"""Arithmetic. Integers are long, exact quotients are structs (num, den), inexact numbers double."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _div(a: Column, b: Column) -> Column:
    """Whole division of longs, exactly."""
    return F.call_function("div", a, b)


def add(*xs) -> Column:
    """+."""
    return reduce(lambda a, b: a + b, map(_c, xs), F.lit(0))


def subtract(first, *rest) -> Column:
    """-; with one argument, its negative."""
    return reduce(lambda a, b: a - b, map(_c, rest), _c(first)) if rest else -_c(first)


def multiply(*xs) -> Column:
    """*."""
    return reduce(lambda a, b: a * b, map(_c, xs), F.lit(1))


def gcd(*xs) -> Column:
    """GCD by Euclid's steps inside one expression: 93 steps suffice for any two longs."""
    return reduce(_gcd, (F.abs(_c(x).cast("long")) for x in xs))


def _gcd(a: Column, b: Column) -> Column:
    start = F.struct(a.alias("a"), b.alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["a"])


def lcm(*xs) -> Column:
    both = lambda a, b: F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(_div(a, F.nullif(_gcd(a, b), F.lit(0).cast("long"))) * b)
    return reduce(both, (F.abs(_c(x).cast("long")) for x in xs))


def divide(x, y) -> Column:
    """/: the exact quotient of two integers as (num, den) in lowest terms, den positive; null for a zero divisor."""
    n, d = _c(x).cast("long"), _c(y).cast("long")
    g = F.nullif(_gcd(F.abs(n), F.abs(d)), F.lit(0).cast("long"))
    sign = F.when(d < 0, F.lit(-1)).otherwise(F.lit(1))
    return F.when(d != 0, F.struct(_div(sign * n, g).alias("num"), _div(F.abs(d), g).alias("den")))


def numerator(q: Column) -> Column:
    return q["num"]


def denominator(q: Column) -> Column:
    """The denominator proper (a known defect elsewhere returns the numerator; it is not reproduced)."""
    return q["den"]


def float_divide(x, y) -> Column:
    """FLOAT/."""
    return F.try_divide(_c(x).cast("double"), _c(y).cast("double"))


def quotient(x, y) -> Column:
    """Truncating."""
    a, b = _c(x).cast("long"), _c(y).cast("long")
    return _div(a, F.nullif(b, F.lit(0).cast("long")))


def remainder(x, y) -> Column:
    """Sign of the dividend."""
    return F.try_mod(_c(x).cast("long"), _c(y).cast("long"))


def modulo(x, y) -> Column:
    """Sign of the divisor."""
    a, b = _c(x).cast("long"), _c(y).cast("long")
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def minimum(*xs) -> Column:
    """MIN."""
    return F.least(*map(_c, xs)) if len(xs) > 1 else _c(xs[0])


def maximum(*xs) -> Column:
    """MAX."""
    return F.greatest(*map(_c, xs)) if len(xs) > 1 else _c(xs[0])


def increment(x) -> Column:
    """1+."""
    return _c(x) + 1


def decrement(x) -> Column:
    """-1+, 1-."""
    return _c(x) - 1


def magnitude(x: Column) -> Column:
    """ABS; for a struct (re, im) the modulus."""
    return F.abs(x)


def complex_magnitude(z: Column) -> Column:
    return F.sqrt(z["re"] * z["re"] + z["im"] * z["im"])


def make_rectangular(re, im) -> Column:
    return F.struct(_c(re).cast("double").alias("re"), _c(im).cast("double").alias("im"))


def truncate(x) -> Column:
    return (F.signum(_c(x)) * F.floor(F.abs(_c(x)))).cast("long")


def round_to(x, unit=1) -> Column:
    """ROUND with an optional unit; halves go away from zero."""
    u = _c(unit).cast("double")
    return F.round(_c(x).cast("double") / u) * u + F.lit(0.0)


def scalerep(v, scale: int) -> Column:
    """SCALEREP: a bucket for range keys. A negative scale -n gives (round(v * n), -n); a positive one rounds to a multiple."""
    n = abs(scale)
    value = F.round(_c(v).cast("double") * n) if scale < 0 else F.round(_c(v).cast("double") / n) * n
    return F.struct(value.cast("long").alias("bucket"), F.lit(scale).alias("scale"))


def ilog(n) -> Column:
    """Smallest k with 2 ** k >= n, exactly."""
    x = _c(n).cast("long")
    return F.when(x <= 1, F.lit(0)).otherwise(F.length(F.bin(x - 1))).cast("int")


def expt(base, e) -> Column:
    return F.pow(_c(base).cast("double"), _c(e).cast("double"))


def random_below(n, seed: int, *keys) -> Column:
    """RANDOM: a whole number below n, fixed by the seed and the row's keys, so a repeated task gives it again."""
    return F.pmod(F.xxhash64(F.lit(seed), *map(_c, keys)), _c(n).cast("long"))


def is_zero(x) -> Column:
    return _c(x) == 0


def is_positive(x) -> Column:
    return _c(x) > 0


def is_negative(x) -> Column:
    return _c(x) < 0


def is_odd(x) -> Column:
    return F.abs(_c(x) % 2) == 1


def is_even(x) -> Column:
    return _c(x) % 2 == 0


def compare_chain(op: str, *xs) -> Column:
    """=, <, >, <=, >= over several arguments: every neighbouring pair; null where an argument is null."""
    test = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}[op]
    cols = list(map(_c, xs))
    return reduce(lambda a, b: a & b, (test(a, b) for a, b in zip(cols, cols[1:])), F.lit(True))


def equal(a, b) -> Column:
    """EQ?, EQV?, EQUAL?."""
    return _c(a).eqNullSafe(_c(b))


def inexact_to_exact(x) -> Column:
    return F.round(_c(x)).cast("long")


def exact_to_inexact(x) -> Column:
    return _c(x).cast("double")


def inexact_to_string(x, precision: int) -> Column:
    return F.format_string(f"%.{precision}f", _c(x).cast("double"))


def number_to_string(x, radix: int = 10) -> Column:
    s = _c(x).cast("long")
    body = F.lower(F.conv(F.abs(s).cast("string"), 10, radix))
    return F.when(s < 0, F.concat(F.lit("-"), body)).otherwise(body)


def string_to_number(s, radix: int = 10) -> Column:
    """Null for what is no number."""
    t = _c(s)
    if radix == 10:
        return t.try_cast("double")
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:radix]
    body = F.regexp_replace(t, "^-", "")
    value = F.conv(body, radix, 10).try_cast("long")
    return F.when(F.lower(t).rlike(f"^-?[{digits}]+$"), F.when(t.startswith("-"), -value).otherwise(value))


def floor(x) -> Column:
    return F.floor(_c(x))


def ceiling(x) -> Column:
    return F.ceil(_c(x))


def log(x) -> Column:
    """LOG: natural; null for what is not positive."""
    return F.log(_c(x))


def exp(x) -> Column:
    return F.exp(_c(x))


def sqrt(x) -> Column:
    return F.sqrt(_c(x))


def sin(x) -> Column:
    return F.sin(_c(x))


def cos(x) -> Column:
    return F.cos(_c(x))


def tan(x) -> Column:
    return F.tan(_c(x))


def asin(x) -> Column:
    return F.asin(_c(x))


def acos(x) -> Column:
    return F.acos(_c(x))


def atan(x) -> Column:
    return F.atan(_c(x))


def atan2(y, x) -> Column:
    return F.atan2(_c(y), _c(x))


def real_part(z: Column) -> Column:
    return z["re"]


def imag_part(z: Column) -> Column:
    return z["im"]


def rationalize(x, tolerance: float) -> Column:
    """RATIONALIZE: (num, den) of the simplest denominator up to 1,000 whose fraction lies within the tolerance.

    Denominators are tried in stretches, and a stretch only if those before it hold none. A quick rounding to even picks
    with some slack those that the exact rule then judges; the two differ at halves only, which lie as near.
    """
    slack = lambda v: tolerance + F.abs(v) * 1e-12
    fits = lambda v, most, d: (F.abs(F.rint(v * d) / d - v) <= most) & (F.abs(F.round(v * d) / d - v) <= tolerance)
    first = lambda v, most, a, b: F.get(F.filter(F.sequence(F.lit(a), F.lit(b)).cast("array<double>"), lambda d: fits(v, most, d)), F.lit(0))
    least = lambda v, most: F.coalesce(*(first(v, most, a, b) for a, b in _STRETCHES)).cast("long")
    # a one-element array and a function over it: what is used more than once is computed once
    with_ = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    fraction = lambda v, den: F.when(den.isNotNull(), F.struct(F.round(v * den).cast("long").alias("num"), den.alias("den")))
    return with_(_c(x).cast("double"), lambda v: with_(with_(slack(v), lambda most: least(v, most)), lambda den: fraction(v, den)))


_STRETCHES = ((1, 8), (9, 16), (17, 32), (33, 64), (65, 128), (129, 256), (257, 512), (513, 1000))
_KINDS = {"integer": ("tinyint", "smallint", "int", "bigint"), "real": ("tinyint", "smallint", "int", "bigint", "float", "double"), "inexact": ("float", "double")}


def _of_kind(x, kind: str) -> Column:
    c = _c(x)
    return c.isNotNull() & (F.typeof(c).isin(*_KINDS[kind]) | ((F.typeof(c).startswith("decimal")) if kind != "inexact" else F.lit(False)))


def is_number(x) -> Column:
    return _of_kind(x, "real")


def is_integer(x) -> Column:
    return _of_kind(x, "integer")


def is_real(x) -> Column:
    return _of_kind(x, "real")


def is_rational(x) -> Column:
    """RATIONAL?: an integer, or an exact quotient (num, den)."""
    return _of_kind(x, "integer") | F.typeof(_c(x)).startswith("struct<num:")


def is_complex(x) -> Column:
    """COMPLEX?: a number, or a struct (re, im)."""
    return _of_kind(x, "real") | F.typeof(_c(x)).startswith("struct<re:")


def is_exact(x) -> Column:
    return _of_kind(x, "integer")


def is_inexact(x) -> Column:
    return _of_kind(x, "inexact")
