"""Exact medians of several columns per key, by histograms that are refined where the middle lies.

All columns are taken together: a row of a key, a column and a different value with its count. A round cuts the span
of every (key, column) that is still open to ``BINS`` equal bins, counts them, and goes on with the bin that holds the
middle, from its least to its greatest value; a bin of one value is the answer. Bins follow the order of the values, so
the result is exact, and the ends of a span never share a bin, so every round narrows it. Nothing is sorted but at
most ``BINS`` counts a key, and no key's values are held in one buffer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import ensure_checkpoint_dir

BINS = 512


def land_rows(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that several passes read one result."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/rows-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def group_medians(df: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """``key`` and a median (pandas ``median``: NULL and NaN left out, the mean of the middle two) of each column of ``values``
    (column -> output name). A key without any value has no row; NULL is a key of its own."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in values]))
    points = df.select(F.struct(key).alias("k"), cells.alias("x")).select("k", "x.c", "x.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    points = land_rows(points.groupBy("k", "c", "v").agg(F.count(F.lit(1)).alias("w")), "points")
    spans = points.groupBy("k", "c").agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    middle = F.array_distinct(F.array(F.expr("(n + 1) div 2"), F.expr("(n + 2) div 2")))
    state = land_rows(spans.select("k", "c", "lo", "hi", F.posexplode(middle).alias("side", "rank")), "spans")
    done = state.where("lo = hi")
    while state.where("lo < hi").limit(1).count():
        state = land_rows(_narrowed(points, state.where("lo < hi")), "spans")
        done = done.unionByName(state.where("lo = hi"))
    lo, hi = F.min("lo"), F.max("lo")
    mid = done.groupBy("k", "c").agg((lo + (hi - lo) * F.lit(0.5)).alias("m"))
    wide = mid.groupBy("k").agg(*[F.max(F.when(F.col("c") == c, F.col("m"))).alias(out) for c, out in values.items()])
    return wide.select(F.col(f"k.{key}").alias(key), *values.values())


def _narrowed(points: DataFrame, state: DataFrame) -> DataFrame:
    """The state with each span cut to the bin that holds its rank."""
    inside = points.join(state, ["k", "c"]).where(F.col("v").between(F.col("lo"), F.col("hi")))
    # the ends have bins of their own, also where a span is not finite
    share = F.nanvl((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0))
    within = F.greatest(F.lit(1), F.least(F.floor(share * BINS), F.lit(BINS - 2)))
    at = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), BINS - 1).otherwise(within)
    bins = inside.groupBy("k", "c", "side", "rank", at.alias("bin"))
    counts = bins.agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = F.sum("w").over(Window.partitionBy("k", "c", "side").orderBy("bin"))
    found = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("w") < F.col("rank")))
    return found.select("k", "c", "lo", "hi", "side", (F.col("rank") - (F.col("upto") - F.col("w"))).alias("rank"))
