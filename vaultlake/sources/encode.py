"""Column builders for tagged JSON values (the decoded-ledger text format).

Used by the adapters that present the driver tables as ledger tables; concat-built text keeps every
value exactly as the ledger decoder would print it, including both i128 encodings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultlake.config import TWO_POW_64


def s(text: str) -> Column:
    return F.lit(text)


def quoted(c: Column) -> Column:
    return F.concat(s('"'), c, s('"'))


def address(c: Column) -> Column:
    return F.concat(s('{"address":'), quoted(c), s("}"))


def string_val(c: Column) -> Column:
    return F.concat(s('{"string":'), quoted(c), s("}"))


def symbol(text: str) -> str:
    return '{"symbol":"%s"}' % text


def topics(*words: str) -> str:
    return "[" + ",".join(symbol(w) for w in words) + "]"


def i128(units: Column, scalar: Column | bool = False) -> Column:
    """JSON of an i128 value from a signed integer column (two's-complement halves or scalar text)."""
    u = units.cast("bigint")
    lo = F.when(u < 0, (u.cast("decimal(20,0)") + F.lit(TWO_POW_64).cast("decimal(20,0)")).cast("string")).otherwise(
        u.cast("string")
    )
    hi = F.when(u < 0, s("-1")).otherwise(s("0"))
    halves = F.concat(s('{"i128":{"hi":'), hi, s(',"lo":'), lo, s("}}"))
    if isinstance(scalar, bool):
        scalar = F.lit(scalar)
    return F.when(scalar, F.concat(s('{"i128":"'), u.cast("string"), s('"}'))).otherwise(halves)


def entry(sym: str, val: Column) -> Column:
    return F.concat(s('{"key":%s,"val":' % symbol(sym)), val, s("}"))


def scmap(*entries: Column) -> Column:
    parts: list[Column] = [s('{"map":[')]
    for i, e in enumerate(entries):
        if i:
            parts.append(s(","))
        parts.append(e)
    parts.append(s("]}"))
    return F.concat(*parts)


def vec(*elems: Column) -> Column:
    parts: list[Column] = [s('{"vec":[')]
    for i, e in enumerate(elems):
        if i:
            parts.append(s(","))
        parts.append(e)
    parts.append(s("]}"))
    return F.concat(*parts)


def vec_joined(joined: Column) -> Column:
    """{"vec":[...]} around an already comma-joined element list."""
    return F.concat(s('{"vec":['), joined, s("]}"))
