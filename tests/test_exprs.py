"""Rounding traps T1/T2: exact DECIMAL half-up on Spark equals the integer oracle form."""

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from marketlens.functions import sqltext
from marketlens.functions.exprs import pct, ratio

CASES = [(57, 800), (1, 8), (-1, 8), (5, 3), (-7, 400), (0, 5), (3, 0), (12345, 1000)]


@pytest.mark.parametrize("num,den", CASES)
def test_pct_matches_oracle(spark, num, den):
    got = spark.range(1).select(pct(F.lit(num), F.lit(den)).cast("double").alias("x")).first()["x"]
    sql = f"SELECT CAST({sqltext.pct(str(num), str(den))} AS DOUBLE)"
    want = duckdb.sql(sql).fetchall()[0][0]
    assert got == want
    if den:
        exact = (Decimal(100 * num) / Decimal(den)).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")
        assert got == float(exact)


def test_half_up_not_binary(spark):
    # 100 * 57 / 800 = 7.125 exactly: half-up gives 7.13 (a DOUBLE division gives 7.12)
    assert spark.range(1).select(pct(F.lit(57), F.lit(800)).cast("double")).first()[0] == 7.13


def test_money_average(spark):
    df = spark.createDataFrame([(Decimal("0.05"),), (Decimal("0.10"),)], "v decimal(12,2)")
    got = df.agg(ratio(F.sum("v"), F.count("v"), 1).cast("double")).first()[0]
    assert got == 0.1  # 0.075 -> 0.1 half-up
    sql = "SELECT CAST(" + sqltext.avg("v", s=1, scale=2) + " AS DOUBLE) FROM (VALUES (0.05::DECIMAL(12,2)), (0.10::DECIMAL(12,2))) t(v)"
    assert duckdb.sql(sql).fetchall()[0][0] == 0.1


def test_shares_are_rounded_once(spark):
    """Near-half shares of a large total, against integer arithmetic."""
    import random
    from decimal import Decimal

    from marketlens.functions.exprs import pct

    total, rng, rows = 123_456_789_012, random.Random(1), []
    for _ in range(60):
        half = rng.randrange(10**6) * 2 + 1  # an odd number of half units of the fourth decimal of a per cent
        cents = half * total // (2 * 10**6)
        rows += [(Decimal(c).scaleb(-2), Decimal(total).scaleb(-2)) for c in (cents - 1, cents, cents + 1)]
    rows += [(-a, b) for a, b in rows[:30]] + [(Decimal(1), Decimal(0)), (None, Decimal(1))]
    got = [r[0] for r in spark.createDataFrame(rows, "a decimal(24,2), b decimal(24,2)").select(pct("a", "b", 4)).collect()]

    def exact(a, b):
        if a is None or not b:
            return None
        n, d = int(abs(a) * 100), int(b * 100)
        q = (2 * n * 100 * 10**4 + d) // (2 * d)
        return Decimal(-q if a < 0 else q).scaleb(-4)

    assert got == [exact(a, b) for a, b in rows]
