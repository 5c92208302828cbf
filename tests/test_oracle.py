"""Every key with an oracle matches DuckDB on the driver tables (sf0.001); keys without one have
tests of their own."""

import os

import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from tools.compare import duck, rows_of

KEYS = sorted(E.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_key(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    ocols, orows = duck(SF_SMALL, E.oracle_sql()[key])
    a, an = rows_of(df.columns, rows)
    b, bn = rows_of(ocols, orows)
    assert an == bn
    assert a == b


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
