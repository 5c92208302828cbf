"""Time buckets that keep TIMESTAMP_NTZ and do not depend on the session time zone.

Ledger times are wall-clock UTC without zone.  date_trunc() returns a zoned TIMESTAMP, so
buckets are built from the date and the hour of the NTZ value instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_bucket(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def hour_bucket(ts: Column) -> Column:
    return day_bucket(ts) + F.make_dt_interval(hours=F.hour(ts))


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def ntz_literal(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
