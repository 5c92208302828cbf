from vaultlake.functions.i128 import i128, i128_units
from vaultlake.functions.payload import (
    addresses,
    field_values,
    parse_entries,
    parse_payload,
    sum_skip_nulls,
)
from vaultlake.functions.time import day_bucket, hour_bucket, micros_between

__all__ = [
    "addresses",
    "day_bucket",
    "field_values",
    "hour_bucket",
    "i128",
    "i128_units",
    "micros_between",
    "parse_entries",
    "parse_payload",
    "sum_skip_nulls",
]
