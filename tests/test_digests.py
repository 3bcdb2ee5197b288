"""Distinct values and rows by digests equal Spark's own distinct counts."""

from pyspark.sql import functions as F

from marketlens.operators import digests, observed


def test_distinct_values(spark):
    rows = [(1, "a", 1.5, None), (1, "a", 1.5, None), (2, "", -0.0, "x"), (2, "", 0.0, "x"), (3, "1:a", 0.0, "-"), (31, ":a", 0.0, None), (None, None, None, None)]
    t = spark.createDataFrame(rows, "n int, s string, d double, u string")
    other = spark.createDataFrame([("a",), ("b",)], "s string")
    got = {(r[0], r[1]): r[2] for r in digests.distinct_values({"t": t, "o": other, "e": t.limit(0)}).collect()}
    want = {("t", c): t.agg(F.count_distinct(c)).first()[0] for c in t.columns}
    want |= {("t", ""): t.distinct().count(), ("o", "s"): 2, ("o", ""): 2, ("e", ""): 0} | {("e", c): 0 for c in t.columns}
    assert got == want


def test_profiles_move_digests_only(spark):
    from conftest import SF_SMALL

    from marketlens.plans.catalog import marketplace

    m = marketplace(spark, SF_SMALL)
    plan = digests.distinct_values(m.raw)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and not any("review_comment" in line for line in moved)


def test_inventory(spark):
    t = spark.createDataFrame([(1, None), (1, None), (2, "x")], "n int, s string")
    frames = {"t": t}
    r = digests.dataset_inventory(frames, observed.measure(frames, {}), digests.distinct_values(frames)).first()
    assert tuple(r) == ("t", 3, 2, 1, 2)


def test_texts_are_worked_out_once(spark):
    """A cell's text is one expression of the plan, though its row and both hashes read it."""
    df = spark.range(3).selectExpr("id", "id / 3.0D AS price")
    plan = digests._cells(df, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS v2#") == 1
    assert plan.count("as string), UTF-8") - plan.count("length(v") == 2
