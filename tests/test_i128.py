"""Golden cases and a round-trip property for the exact i128 decoder."""

from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultlake.functions.i128 import i128
from vaultlake.sources import encode as J

GOLDEN = [
    ('{"i128":{"hi":0,"lo":12345678901}}', Decimal("1234.5678901")),
    ('{"i128":{"hi":-1,"lo":18446744073709551615}}', Decimal("-0.0000001")),
    ('{"i128":{"hi":1,"lo":5}}', Decimal("1844674407370.9551621")),
    ('{"i128":"42"}', Decimal("0.0000042")),
    ('{"i128":{"lo":5}}', None),
    ('{"i128":"abc"}', None),
    ('{"i128":{"hi":0', None),
    (None, None),
]


def test_golden(spark):
    df = spark.createDataFrame([(j,) for j, _ in GOLDEN], "j string")
    got = [r[0] for r in df.select(i128(F.col("j"))).collect()]
    assert got == [e for _, e in GOLDEN]
    assert df.select(i128(F.col("j"))).schema[0].dataType.simpleString() == "decimal(38,7)"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(min_value=-(2**63), max_value=2**63 - 1), min_size=1, max_size=20), st.booleans())
def test_round_trip(spark, values, scalar):
    df = spark.createDataFrame([(v,) for v in values], "u bigint")
    enc = df.select(F.col("u"), J.i128(F.col("u"), scalar).alias("j"))
    rows = enc.select("u", i128(F.col("j")).alias("d")).collect()
    for r in rows:
        assert r.d == Decimal(r.u).scaleb(-7)
