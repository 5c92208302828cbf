"""Exact arithmetic on DECIMAL(38,7) token amounts.

Spark gives sums, differences and products of DECIMAL(38,7) a scale of 6 or less.  Here the operands
are first tried with fewer digits, where the result type holds every place; values that need more
digits are computed on whole units (DECIMAL(38,0), 10^-7 tokens), so the full range is kept.  Only
results that do not fit DECIMAL(38,7) are NULL.  Negation and abs() are kept to short numbers: in Spark
they round to 34 digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(38,7)"
UNITS = "decimal(38,0)"
PLACES = 7
_ONE = 10**PLACES
_HALF = 10**19


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast(f"decimal({len(str(n))},0)")


def let(x: Column, f) -> Column:
    """f(x) with x computed once: an expression that is used several times would otherwise be copied
    into each place, and nested uses multiply."""
    return F.element_at(F.transform(F.array(x), f), 1)


def divided(u: Column, n: int) -> tuple[Column, Column]:
    """Quotient (towards zero) and remainder of whole units by n; both exact."""
    rest = u % _whole(n)
    return ((u - rest).cast(UNITS) / _whole(n)).cast(UNITS), rest.cast(UNITS)


def times(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b).cast(UNITS)


def plus(a: Column, b: Column) -> Column:
    return F.try_add(a, b).cast(UNITS)


def _to_units(x: Column) -> Column:
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return plus(times(whole.cast(UNITS), _whole(_ONE)), (x % _whole(1) * _whole(_ONE)).cast("decimal(8,0)"))


def to_units(x: Column) -> Column:
    """x * 10^7 as a whole number; NULL from 10^38 on."""
    return let(x, _to_units)


def from_units(u: Column) -> Column:
    """u * 10^-7: the point is put into the digits, so no place is lost."""

    def text(v):
        digits = F.lpad(v["d"], F.greatest(F.length(v["d"]), F.lit(PLACES + 1)), F.lit("0"))
        whole = F.substring(digits, F.lit(1), F.greatest(F.length(v["d"]), F.lit(PLACES + 1)) - PLACES)
        return F.concat(v["sign"], whole, F.lit("."), F.right(digits, F.lit(PLACES)))

    parts = let(u.cast("string"), lambda t: F.named_struct(F.lit("d"), F.ltrim(t, F.lit("-")), F.lit("sign"), F.when(t.startswith("-"), "-").otherwise("")))
    return let(parts, text).try_cast(DEC)


def scaled(u: Column) -> Column:
    """u * 10^-7; the text form only from 10^30 units on."""
    return F.coalesce((u.try_cast("decimal(30,0)") * F.lit("0.0000001").cast("decimal(7,7)")).cast(DEC), from_units(u))


def _narrow(x: Column) -> Column:
    return x.try_cast("decimal(37,7)")


def add(a: Column, b: Column) -> Column:
    return F.coalesce((_narrow(a) + _narrow(b)).cast(DEC), from_units(plus(to_units(a), to_units(b))))


def subtract(a: Column, b: Column) -> Column:
    return F.coalesce((_narrow(a) - _narrow(b)).cast(DEC), from_units(F.try_subtract(to_units(a), to_units(b)).cast(UNITS)))


def multiply(a: Column, b: Column) -> Column:
    """a * b, rounded once (half away from zero) to 7 places."""
    near = (a.try_cast("decimal(24,7)") * b.try_cast("decimal(13,7)")).cast(DEC)
    return F.coalesce(near, _multiply_units(a, b))


def _multiply_units(a: Column, b: Column) -> Column:
    def halves(v):
        a1, a0 = divided(v["a"], _HALF)
        b1, b0 = divided(v["b"], _HALF)
        return F.named_struct(F.lit("a1"), F.abs(a1), F.lit("a0"), F.abs(a0), F.lit("b1"), F.abs(b1), F.lit("b0"), F.abs(b0))

    def product(v):
        middle = times(plus(times(v["a1"], v["b0"]), times(v["a0"], v["b1"])), _whole(_HALF // _ONE))
        high = times(times(v["a1"], v["b1"]), _whole(_HALF * _HALF // _ONE))
        return plus(plus(high, middle), let(times(v["a0"], v["b0"]), rounded))

    def rounded(u):
        low, rest = divided(u, _ONE)
        return plus(low, F.when(rest * 2 >= _ONE, 1).otherwise(0).cast(UNITS))

    total = let(let(F.named_struct(F.lit("a"), to_units(a), F.lit("b"), to_units(b)), halves), product)
    signed = let(total, lambda t: F.when((a < 0) != (b < 0), F.try_subtract(F.lit(0).cast(UNITS), t)).otherwise(t).cast(UNITS))
    return from_units(signed)


def _share_by_bits(rest: Column, of: Column, whole: Column) -> Column:
    """floor(rest * of / whole) for 0 <= rest < whole, without a product: quotient and remainder are doubled
    for each binary digit of `of` and `rest` is added where it is 1, all below `whole`."""

    def over(a, b):
        return a >= F.try_subtract(whole, b)

    def sum_below(a, b):
        return F.when(over(a, b), F.try_subtract(a, F.try_subtract(whole, b))).otherwise(F.try_add(a, b)).cast(UNITS)

    def one(c):
        return F.when(c, 1).otherwise(0).cast(UNITS)

    def doubled(s, power):
        taken = s["left"] >= power
        return F.named_struct(
            F.lit("q"), plus(plus(s["q"], s["q"]), one(over(s["r"], s["r"]))), F.lit("r"), sum_below(s["r"], s["r"]),
            F.lit("left"), F.when(taken, F.try_subtract(s["left"], power)).otherwise(s["left"]).cast(UNITS), F.lit("taken"), taken,
        )

    def added(s):
        return F.named_struct(
            F.lit("q"), plus(s["q"], one(s["taken"] & over(s["r"], rest))),
            F.lit("r"), F.when(s["taken"], sum_below(s["r"], rest)).otherwise(s["r"]).cast(UNITS), F.lit("left"), s["left"],
        )

    zero = F.lit(0).cast(UNITS)
    start = F.named_struct(F.lit("q"), zero, F.lit("r"), zero, F.lit("left"), of)
    powers = F.array(*[F.lit(str(2**i)).cast(UNITS) for i in range(126, -1, -1)])
    return F.aggregate(powers, start, lambda s, p: let(doubled(s, p), added), lambda s: s["q"])


def floor_share(x: Column, of: Column, whole: Column) -> Column:
    """floor(x * of / whole) of non-negative amounts, in whole units; NULL for whole = 0.  With
    x = q * whole + r it is q * of + floor(r * of / whole)."""

    def exact(u, w):
        return F.try_divide(F.try_subtract(u, u % w), w).cast(UNITS)

    def share(v):
        rest = (v["x"] % v["w"]).cast(UNITS)
        times_in = F.coalesce(exact(v["x"], v["w"]), F.when(v["w"] == 1, v["x"]).otherwise(_share_by_bits(F.lit(1).cast(UNITS), v["x"], v["w"])))
        part = let(times(rest, v["of"]), lambda p: exact(p, v["w"]))
        return plus(times(times_in, v["of"]), F.coalesce(part, _share_by_bits(rest, v["of"], v["w"])))

    def known(v):
        return F.when(v["x"].isNotNull() & v["of"].isNotNull() & v["w"].isNotNull(), share(v))

    operands = F.named_struct(F.lit("x"), to_units(x), F.lit("of"), to_units(of), F.lit("w"), to_units(F.when(whole > 0, whole)))
    return from_units(let(operands, known))
