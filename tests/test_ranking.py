"""Distributed global ranking equals the single-partition window."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.operators.ranking import rank_globally


def _reference(df, desc):
    o = [F.col("v").desc() if desc else F.col("v").asc(), F.col("k")]
    w = W.orderBy(*o)
    return df.select(
        "k",
        F.row_number().over(w).alias("rn"),
        F.dense_rank().over(W.orderBy(o[0])).alias("dr"),
        F.ntile(5).over(w).alias("nt5"),
        F.ntile(4).over(w).alias("nt4"),
        F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("cs"),
        F.count(F.lit(1)).over(W.partitionBy()).alias("tc"),
    )


def _ranked(df, desc, buckets):
    r = rank_globally(
        df,
        [("v", desc), ("k", False)],
        row_number="rn",
        dense_rank=("dr", ["v"]),
        ntiles={"nt5": 5, "nt4": 4},
        running_sum=("v", "cs"),
        total_count="tc",
        buckets=buckets,
    )
    return r.select("k", "rn", "dr", "nt5", "nt4", "cs", "tc")


@pytest.mark.parametrize("desc", [True, False])
@pytest.mark.parametrize("buckets", [1, 7, 15])
def test_hot_value_split_across_buckets(spark, desc, buckets):
    # a third of all rows share one value: the tie-breaker splits them across buckets
    df = spark.range(3001).select(
        F.lpad(F.col("id").cast("string"), 6, "0").alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.pmod(F.col("id") * 7919, F.lit(37))).cast("decimal(12,2)").alias("v"),
    )
    got = sorted(tuple(r) for r in _ranked(df, desc, buckets).collect())
    want = sorted(tuple(r) for r in _reference(df, desc).collect())
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=6), min_size=1, max_size=60), st.integers(min_value=1, max_value=9))
def test_random_data_random_buckets(spark, values, buckets):
    rows = [(f"{i:04d}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, v int").withColumn("v", F.col("v").cast("decimal(12,2)"))
    got = sorted(tuple(r) for r in _ranked(df, True, buckets).collect())
    want = sorted(tuple(r) for r in _reference(df, True).collect())
    assert got == want


def test_no_single_partition_exchange(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 97).alias("v"))
    r = rank_globally(df, [("v", True), ("k", False)], row_number="rn", buckets=6)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert r.rdd.getNumPartitions() >= 1


@pytest.mark.parametrize("buckets", [1, 5, 13])
def test_row_number_within_hot_group(spark, buckets):
    from marketlens.operators.ranking import row_number_within

    # group "g0" holds a third of all rows and spans many buckets
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("g0")).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        F.pmod(F.col("id") * 7919, F.lit(1000)).alias("s"),
        F.col("id").alias("k"),
    )
    got = sorted(tuple(r) for r in row_number_within(df, ["g"], [("s", False), ("k", False)], out="rn", buckets=buckets).select("k", "rn").collect())
    w = W.partitionBy("g").orderBy("s", "k")
    want = sorted(tuple(r) for r in df.select("k", F.row_number().over(w).alias("rn")).collect())
    assert got == want


@pytest.mark.parametrize("desc", [True, False])
def test_null_keys_sort_like_a_window(spark, desc):
    rows = [(f"{i:03d}", None if i % 4 == 0 else i % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, v int").withColumn("v", F.col("v").cast("decimal(12,2)"))
    got = sorted(tuple(r) for r in _ranked(df, desc, 9).drop("cs").collect())
    want = sorted(tuple(r) for r in _reference(df, desc).drop("cs").collect())
    assert got == want


def test_default_uses_many_partitions(spark):
    """Small inputs take the same path as large ones: as many ranges as shuffle partitions."""
    from marketlens.operators.ranking import _ranged

    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 97).alias("v"))
    assert _ranged(df, [("v", True), ("k", False)], None).select("_b").distinct().count() >= 8


def test_thousands_of_ranges_plan_quickly(spark):
    import time

    df = spark.range(20).select(*[F.col("id").alias(c) for c in "abcdefg"])
    t = time.time()
    rank_globally(df, [(c, False) for c in "abcdefg"], row_number="rn", buckets=64)
    few = time.time() - t
    from marketlens.operators.ranking import _sort_columns

    t = time.time()
    df.repartitionByRange(4096, *_sort_columns([(c, False) for c in "abcdefg"])).sortWithinPartitions(*"abcdefg")._jdf.queryExecution().executedPlan()
    assert time.time() - t < 2 and few < 60


def test_running_weight_within_groups(spark):
    from marketlens.operators.ranking import row_number_within

    df = spark.range(400).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), F.col("id").alias("k"), (F.col("id") % 4).alias("w"))
    got = sorted(tuple(r) for r in row_number_within(df, ["g"], [("k", False)], out="s", buckets=7, weight="w").select("k", "s").collect())
    w = W.partitionBy("g").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    assert got == sorted(tuple(r) for r in df.select("k", F.sum("w").over(w)).collect())


def test_total_sum(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("k"), F.col("id").cast("decimal(12,2)").alias("v"))
    r = rank_globally(df, [("v", True), ("k", False)], row_number="rn", total_sum=("v", "t"), buckets=5)
    assert {float(x.t) for x in r.collect()} == {1225.0}


@pytest.mark.parametrize("limit", [1, 5, 10**6])
def test_number_rows_of_small_and_large_groups(spark, limit):
    """Groups beyond the limit are numbered apart; a head that comes twice doubles its rows before they are numbered."""
    from marketlens.operators.ranking import number_rows

    rows = [(g, s) for g in range(8) for s in range(g * g)] + [(None, 1), (99, 1)]
    heads = [(g, f"h{g}") for g in range(8)] + [(3, "again"), (None, "h")]
    df = spark.createDataFrame(rows, "g int, s int")
    got = sorted(tuple(r) for r in number_rows(df, spark.createDataFrame(heads, "g int, h string"), "g", [("s", False)], out="rn", limit=limit).select("g", "s", "rn").collect())
    want = [(g, s, s + 1) for g in range(8) if g != 3 for s in range(g * g)] + [(3, i // 2, i + 1) for i in range(18)]
    assert got == sorted(want)
