"""Exact amounts: golden cases at the ends of DECIMAL(38,7), and random ones against Python."""

import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import functions as F

from vaultlake.functions.decimals import DEC, add, floor_share, from_units, multiply, subtract, to_units
from vaultlake.functions.i128 import i128
from vaultlake.functions.payload import sum_skip_nulls

LIMIT = Decimal(10) ** 31


def fit(x):
    return x if abs(x) < LIMIT else None


def numbers(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        digits = r.choice([1, 3, 7, 8, 12, 20, 30, 31, 37, 38])
        out.append(Decimal(r.randrange(10**digits)).scaleb(-7) * r.choice([1, -1]))
    return out


def test_sum_difference_product_are_exact(spark):
    with localcontext() as c:
        c.prec = 100
        a = numbers(1, 400) + [Decimal("0.0000001"), Decimal("1.2345671"), Decimal("0.0000003"), Decimal(10) ** 17, Decimal(0)]
        b = numbers(2, 400) + [Decimal("0.0000002"), Decimal("1.2345672"), Decimal("0.0000001"), Decimal(1), Decimal(0)]
        pairs = list(zip(a, b)) + [(x / 10**12, y) for x, y in [(Decimal(10) ** 20, Decimal("1234567.1234567"))]]
        pairs = [(x.quantize(Decimal("1e-7")), y.quantize(Decimal("1e-7"))) for x, y in pairs]
        df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], f"i int, x {DEC}, y {DEC}")
        x, y = F.col("x"), F.col("y")
        got = df.select("i", add(x, y), subtract(x, y), multiply(x, y), from_units(to_units(x)), sum_skip_nulls(F.array(x, F.lit(None).cast(DEC), y))).collect()
        for row in got:
            p, q = pairs[row[0]]
            product = (p * q).quantize(Decimal("1e-7"), ROUND_HALF_UP)
            assert [row[1], row[2], row[3], row[4], row[5]] == [fit(p + q), fit(p - q), fit(product), p, fit(p + q)], (p, q)


def test_i128_up_to_the_bound(spark):
    values = [0, 1, -1, 10**29, 10**30, 10**31, 10**38 - 1, -(10**38) + 1, 2**127 - 1, -(2**127)]
    rows = [(v, '{"i128":"%d"}' % v, '{"i128":{"hi":%d,"lo":%d}}' % (v >> 64, v & (2**64 - 1))) for v in values]
    df = spark.createDataFrame([(str(v), s, h) for v, s, h in rows], "v string, s string, h string")
    for v, s, h in df.select("v", i128(F.col("s")), i128(F.col("h"))).collect():
        with localcontext() as c:
            c.prec = 60
            want = Decimal(v).scaleb(-7) if abs(int(v)) < 10**38 else None
        assert s == want and h == want, v


def test_floor_share_over_the_whole_range(spark):
    r = random.Random(3)
    top = 10**38 - 1
    units = [(10**19, 3 * 10**19, 7 * 10**19), (top - 1, top - 1, top), (top, top, top), (top - 1, 1, top), (0, 5, 7), (5, 0, 7), (5, 5, 0), (top, 2, 1)]
    for _ in range(200):
        w = r.randrange(1, 10 ** r.choice([3, 12, 20, 30, 37, 38]))
        units.append((r.randrange(0, w + 1), r.randrange(10 ** r.choice([1, 12, 25, 38])), w))
    with localcontext() as c:
        c.prec = 100
        rows = [(i, *[Decimal(u).scaleb(-7) for u in t]) for i, t in enumerate(units)]
        df = spark.createDataFrame(rows, f"i int, x {DEC}, f {DEC}, w {DEC}")
        for i, got in df.select("i", floor_share(F.col("x"), F.col("f"), F.col("w"))).collect():
            x, f, w = units[i]
            want = x * f // w if w else None
            want = None if want is None or want > top else Decimal(want).scaleb(-7)
            assert got == want, units[i]
