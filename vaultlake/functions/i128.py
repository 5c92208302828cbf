"""Exact decoding of 128-bit ledger integers to DECIMAL(38,7).

An i128 value arrives as JSON text in one of two encodings:
  {"i128": {"hi": H, "lo": L}}   value = H * 2^64 + L   (H signed, L unsigned 64-bit)
  {"i128": "N"}                  value = N
and is scaled by 10^-7 (token units).  Anything that does not decode gives NULL, never an error.

The value is assembled as an integer first (try_* arithmetic: overflow -> NULL) and only then scaled
exactly (functions.decimals); NULL only beyond DECIMAL(38,7).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultlake.config import TWO_POW_64
from vaultlake.functions.decimals import let, scaled

DEC = "decimal(38,7)"


def _try_dec(c: Column, precision: int) -> Column:
    return c.try_cast(f"decimal({precision},0)")


def _from_halves(hi: Column, lo: Column) -> Column:
    """hi * 2^64 + lo; of negative numbers hi is raised by one first, so that no step is longer than
    the result."""
    hi, lo, base = _try_dec(hi, 19), _try_dec(lo, 20), F.lit(TWO_POW_64).cast("decimal(20,0)")
    near = F.try_add(F.try_multiply(hi, base), lo)
    return F.when(hi < 0, F.try_add(F.try_multiply(hi + 1, base), lo - base)).otherwise(near)


def _units(hi: Column, lo: Column, scalar: Column) -> Column:
    """The texts are read from the JSON once: inside a higher-order function every use would read them again."""

    def value(p):
        return F.when(p["hi"].isNotNull(), _from_halves(p["hi"], p["lo"])).when(p["scalar"].isNotNull(), _try_dec(p["scalar"], 38))

    return let(F.named_struct(F.lit("hi"), hi, F.lit("lo"), lo, F.lit("scalar"), scalar), value)


def i128_units(j: Column) -> Column:
    """Integer value (DECIMAL(38,0)) of an i128 JSON text, NULL if it does not decode."""
    return _units(F.get_json_object(j, "$.i128.hi"), F.get_json_object(j, "$.i128.lo"), F.get_json_object(j, "$.i128"))


def scale_units(units: Column) -> Column:
    """units * 10^-7 as DECIMAL(38,7)."""
    return scaled(units)


def i128(j: Column) -> Column:
    """DECIMAL(38,7) token amount of an i128 JSON text."""
    return scale_units(i128_units(j))


def i128_from_value_text(t: Column) -> Column:
    """DECIMAL(38,7) from the text of an `i128` field itself: `{"hi":H,"lo":L}` or a scalar."""
    return scale_units(_units(F.get_json_object(t, "$.hi"), F.get_json_object(t, "$.lo"), t))
