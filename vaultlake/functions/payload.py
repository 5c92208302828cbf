"""Access to event payloads and state values stored as tagged JSON trees.

A payload is {"map":[{"key":{"symbol":S},"val":V}, ...]}.  It is parsed once per row with a
partial schema in which V stays JSON text; fields are then picked with higher-order functions, so
no row is exploded and no shuffle is needed to read several fields of one payload.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY_TYPE = "array<struct<key:struct<symbol:string>,val:string>>"
PAYLOAD_SCHEMA = f"struct<map:{ENTRY_TYPE}>"
VEC_SCHEMA = "struct<vec:array<string>>"


def parse_payload(j: Column) -> Column:
    """Array of (key.symbol, val-json) entries of a payload map; NULL if malformed."""
    return F.from_json(j, PAYLOAD_SCHEMA).getField("map")


def parse_entries(j: Column) -> Column:
    """Parse a JSON array of map entries (the value of a "map" key taken with a JSON path)."""
    return F.from_json(j, ENTRY_TYPE)


def parse_vec(j: Column) -> Column:
    """Elements (JSON text) of {"vec":[...]}."""
    return F.from_json(j, VEC_SCHEMA).getField("vec")


def field_values(entries: Column, symbols: str | Sequence[str]) -> Column:
    """JSON texts of the values whose key symbol is one of `symbols` (in payload order)."""
    syms = [symbols] if isinstance(symbols, str) else list(symbols)
    return F.transform(
        F.filter(entries, lambda e: e.getField("key").getField("symbol").isin(syms)),
        lambda e: e.getField("val"),
    )


def first_value(entries: Column, symbol: str) -> Column:
    return F.try_element_at(field_values(entries, symbol), F.lit(1))


def addresses(vals: Column) -> Column:
    """`$.address` of each value JSON."""
    return F.transform(vals, lambda v: F.get_json_object(v, "$.address"))


def sum_skip_nulls(arr: Column) -> Column:
    """SQL SUM over an array of DECIMAL(38,7), exact: NULL elements ignored, NULL when no element is
    non-NULL."""
    from vaultlake.functions.decimals import DEC, add

    return F.aggregate(
        arr, F.lit(None).cast(DEC), lambda acc, x: F.when(x.isNull(), acc).when(acc.isNull(), x).otherwise(add(acc, x))
    )


def max_skip_nulls(arr: Column) -> Column:
    return F.array_max(arr)


# Typed form: one parse per payload; only the small leaves stay text.  `val` keeps the tags the
# queries read (address, i128 as text, string, vec elements as text); other tags are ignored.
VAL_TYPE = "struct<address:string,i128:string,string:string,vec:array<string>,u32:string,bytes:string,map:string>"
TYPED_ENTRY_TYPE = f"array<struct<key:struct<symbol:string>,val:{VAL_TYPE}>>"
TYPED_PAYLOAD_SCHEMA = f"struct<map:{TYPED_ENTRY_TYPE}>"


def parse_typed(j: Column) -> Column:
    """Entries of {"map":[...]} with typed values.  Select it as its own column before reading
    several fields: higher-order functions are interpreted, so an inline parse would be repeated
    for every field read."""
    return F.from_json(j, TYPED_PAYLOAD_SCHEMA).getField("map")


def _matching(entries: Column, symbols: str | Sequence[str]) -> Column:
    syms = [symbols] if isinstance(symbols, str) else list(symbols)
    return F.filter(entries, lambda e: e.getField("key").getField("symbol").isin(syms))


def typed_i128s(entries: Column, symbols: str | Sequence[str]) -> Column:
    from vaultlake.functions.i128 import i128_from_value_text

    return F.transform(_matching(entries, symbols), lambda e: i128_from_value_text(e.getField("val").getField("i128")))


def typed_addresses(entries: Column, symbols: str | Sequence[str]) -> Column:
    return F.transform(_matching(entries, symbols), lambda e: e.getField("val").getField("address"))


def typed_vecs(entries: Column, symbols: str | Sequence[str]) -> Column:
    """Elements (JSON text) of the `vec` values of the matching entries, concatenated."""
    return F.flatten(
        F.transform(
            _matching(entries, symbols),
            lambda e: F.coalesce(e.getField("val").getField("vec"), F.array().cast("array<string>")),
        )
    )
