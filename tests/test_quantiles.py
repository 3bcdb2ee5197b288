"""Quantile groups and grouped medians from histograms equal the plain window and pandas."""

import random
import statistics

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.operators.medians import group_medians
from marketlens.operators.quantiles import Tiles, with_tiles


def _same(df, orders):
    got = {r["id"]: tuple(r[o] for o in orders) for r in with_tiles(df, orders).collect()}
    tiles = [F.ntile(t.k).over(W.orderBy(F.col(t.value).asc_nulls_first(), t.id)).alias(o) for o, t in orders.items()]
    assert got == {r["id"]: tuple(r[o] for o in orders) for r in df.select("id", *tiles).collect()}


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id string, a string, b long").withColumn("a", F.col("a").cast("decimal(18,2)"))


ORDERS = {"qa": Tiles("a", "id", 4), "qb": Tiles("b", "id", 5), "qc": Tiles("a", "id", 3)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 500])
def test_random_values(spark, n):
    rng = random.Random(n)
    rows = [(f"s{i:05d}", str(rng.randrange(-5000, 10_000) / 100), rng.choice([rng.randrange(-(2**40), 2**40), rng.randrange(9)])) for i in range(n)]
    _same(_frame(spark, rows), ORDERS)


def test_ties_are_cut_by_id(spark):
    """All borders fall into one value with most rows; ids share prefixes, and some are prefixes of others."""
    rows = [(f"{'ab' * (i % 5)}{i}", "3.50", 7) for i in range(400)] + [(f"{'x' * i}", "3.50", 7) for i in range(1, 40)] + [("é" * i, "3.50", 8) for i in range(1, 9)]
    _same(_frame(spark, rows), ORDERS)


def test_nulls_come_first(spark):
    rows = [(f"n{i:03d}", None, None) for i in range(60)] + [(f"v{i:03d}", str(i % 3), None) for i in range(40)]
    _same(_frame(spark, rows), ORDERS)
    _same(_frame(spark, rows[:60]), ORDERS)


def test_a_hot_value_and_extremes(spark):
    rows = [(f"h{i:04d}", "0", 0) for i in range(900)] + [("lo", "-9999999999999999.99", -(2**61)), ("hi", "9999999999999999.99", 2**61)]
    _same(_frame(spark, rows), {"qa": Tiles("a", "id", 4), "qb": Tiles("b", "id", 7)})


def test_binary_floats_are_refused(spark):
    with pytest.raises(TypeError):
        with_tiles(spark.createDataFrame([("a", 1.5)], "id string, v double"), {"q": Tiles("v", "id", 4)})


def test_seller_risk_plan_sorts_nothing(spark):
    from conftest import SF_SMALL

    from marketlens.plans.registry import ALL_QUERIES

    plan = ALL_QUERIES["seller_risk"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_grouped_medians(spark):
    rng = random.Random(2)
    rows = [("hot", rng.random() * 180 - 90, rng.choice([1.5, 2.5])) for _ in range(4000)]
    rows += [(rng.choice("abcdefg"), rng.gauss(0, 1e-9), float(rng.randrange(3))) for _ in range(600)]
    rows += [("one", 4.0, None), ("two", 1.0, float("nan")), ("two", 2.0, 7.0), (None, 5.0, 5.0), ("none", None, None)]
    rows += [("wide", v, v) for v in (-1e308, 1e308, 0.0, 5e-324, 1.0, float("inf"))]
    got = {r.k: (r.mx, r.my) for r in group_medians(spark.createDataFrame(rows, "k string, x double, y double"), "k", {"x": "mx", "y": "my"}).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        both = [[r[i] for r in rows if r[0] == k and r[i] is not None and r[i] == r[i]] for i in (1, 2)]
        if any(both):
            want[k] = tuple(_median(v) if v else None for v in both)
    assert got == want


def _median(values):
    v = sorted(values)
    lo, hi = v[(len(v) - 1) // 2], v[len(v) // 2]
    assert lo + (hi - lo) * 0.5 == pytest.approx(statistics.median(values))
    return lo + (hi - lo) * 0.5


def test_medians_of_nothing(spark):
    assert group_medians(spark.createDataFrame([], "k string, x double"), "k", {"x": "m"}).count() == 0
