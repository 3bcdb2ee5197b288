"""Distributed global ranking.

Every window of the reports is global (``OVER (ORDER BY ...)`` with no
PARTITION BY). Written naively in Spark that plans ``Exchange SinglePartition``
and pulls the whole relation into one task. Instead:

1. The input is checkpointed once (range partitioning reads it twice: for its
   sample and for the exchange).
2. ``repartitionByRange(n, <the sort keys>)`` and a local sort: the engine picks
   and searches the boundaries, NULL keys included. ``monotonically_increasing_id``
   then holds the partition in its high bits and the local row number in its
   low bits.
3. Dense rank and running sum are local windows over the partition number.
4. Per-partition statistics (one row a partition) give the offsets, which come
   back by a broadcast bounded by the partition count.

The full sort key includes the tie-breaker, so a value shared by a third of all
rows spreads over many partitions; dense ranks are corrected where a value
straddles a boundary. NULL keys sort as in any Spark window: first ascending,
last descending.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StructField, StructType

from marketlens.session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # of monotonically_increasing_id


def _sort_columns(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c, descending in order]


def _ranged(df: DataFrame, order: list[tuple[str, bool]], partitions: int | None) -> DataFrame:
    """``df`` in ``partitions`` sorted ranges, with ``_b`` (range number) and ``_lrn`` (row number in it, from 1)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = _sort_columns(order)
    numbered = df.checkpoint().repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_id", F.monotonically_increasing_id())
    return numbered.withColumns(
        {"_b": F.shiftright("_id", _LOCAL_BITS), "_lrn": F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)) + 1}
    ).drop("_id")


def rank_globally(
    df: DataFrame,
    order: list[tuple[str, bool]],
    row_number: str | None = None,
    dense_rank: tuple[str, list[str]] | None = None,
    ntiles: dict[str, int] | None = None,
    running_sum: tuple[str, str] | None = None,
    total_count: str | None = None,
    total_sum: tuple[str, str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add global ranking columns ordered by ``order`` [(column, descending)].

    ``dense_rank=(out, value_cols)`` ranks by ``value_cols`` only (a prefix of
    ``order``). ``ntiles={out: k}`` follows PostgreSQL NTILE on the full order.
    ``running_sum=(src, out)`` is ``SUM(src) OVER (ORDER BY ... ROWS UNBOUNDED
    PRECEDING)``. ``total_count`` is ``COUNT(*) OVER ()``, ``total_sum=(src, out)``
    ``SUM(src) OVER ()``.

    ``buckets`` is the number of ranges (default: the session's shuffle
    partitions); it affects parallelism, never the result. The ranked frame is
    checkpointed in the session's checkpoint folder, so this runs jobs when it
    is called; later reads take files, and a lost executor costs a re-read.
    """
    spark = df.sparkSession
    t = _ranged(df, order, buckets)
    local = {}
    if dense_rank:
        values = _sort_columns([(c, d) for c, d in order if c in dense_rank[1]])
        local["_ldr"] = F.dense_rank().over(Window.partitionBy("_b").orderBy(*values))
    if running_sum:
        local["_lrs"] = F.sum(running_sum[0]).over(Window.partitionBy("_b").orderBy("_lrn").rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumns(local).checkpoint()

    # one row a range, on the driver: the offsets frame then carries no lineage of ``t``
    aggs = [F.count(F.lit(1)).alias("_n")]
    if dense_rank:
        value = F.struct(*dense_rank[1])
        aggs += [F.max("_ldr").alias("_d"), F.min_by(value, "_lrn").alias("_first"), F.max_by(value, "_lrn").alias("_last")]
    if running_sum:
        aggs.append(F.sum(running_sum[0]).alias("_s"))
    if total_sum:
        aggs.append(F.sum(total_sum[0]).alias("_t"))
    stats = sorted(t.groupBy("_b").agg(*aggs).collect(), key=lambda r: r["_b"])
    total = sum(r["_n"] for r in stats)
    sum_type = t.schema["_lrs"].dataType if running_sum else LongType()
    before, ranks, sums, last = 0, 0, Decimal(0) if isinstance(sum_type, DecimalType) else 0, None
    offsets = []
    for r in stats:
        if dense_rank and last is not None and r["_first"] == last:
            ranks -= 1  # the first value of this range goes on from the range before
        offsets.append((r["_b"], before, total, ranks, sums))
        before += r["_n"]
        if dense_rank:
            ranks, last = ranks + r["_d"], r["_last"]
        if running_sum and r["_s"] is not None:
            sums += r["_s"]
    fields = [("_b", LongType()), ("_on", LongType()), ("_N", LongType()), ("_od", LongType()), ("_os", sum_type)]
    out = t.join(F.broadcast(spark.createDataFrame(offsets, StructType([StructField(*f) for f in fields]))), "_b")
    rn = F.col("_on") + F.col("_lrn")
    cols = {}
    if row_number:
        cols[row_number] = rn
    if dense_rank:
        cols[dense_rank[0]] = F.col("_od") + F.col("_ldr")
    if running_sum:
        cols[running_sum[1]] = F.col("_os") + F.col("_lrs")
    if total_count:
        cols[total_count] = F.col("_N")
    if total_sum:
        found = [r["_t"] for r in stats if r["_t"] is not None]
        cols[total_sum[1]] = F.lit(sum(found) if found else None).cast("decimal(38,2)")
    for name, k in (ntiles or {}).items():
        cols[name] = ntile_from_row_number(rn, F.col("_N"), k)
    return out.withColumns(cols).drop("_b", "_lrn", "_ldr", "_lrs", "_on", "_N", "_od", "_os")


def ntile_from_row_number(r: Column, n: Column, k: int) -> Column:
    """PostgreSQL NTILE(k) from the 1-based global row number r of N rows.

    The first N mod k tiles hold one extra row.
    """
    base = F.floor(n / k)
    extra = n - base * k
    big = extra * (base + 1)
    return (
        F.when(r <= big, F.ceil(r / (base + 1)))
        .otherwise(extra + F.ceil((r - big) / F.greatest(base, F.lit(1))))
        .cast("int")
    )


def row_number_within(
    df: DataFrame,
    partition_cols: list[str],
    order: list[tuple[str, bool]],
    out: str = "row_number",
    buckets: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY p ORDER BY o)`` that survives a hot group; with ``weight``
    (whole numbers), the running sum of that column up to and including the row.

    Rows are ranged on the group and the order, so a group with a third of all
    rows spans many ranges; row numbers are local to (range, group), and the
    group that goes on from the range before (at most one a range) has its
    earlier rows added. Rows that agree in the whole key stay in one range:
    aggregate them first where they can be many.
    """
    spark = df.sparkSession
    key = F.struct(*partition_cols)
    ranged = _ranged(df, [(c, False) for c in partition_cols] + list(order), buckets).withColumnRenamed("_lrn", "_pos")
    local = Window.partitionBy("_b", *partition_cols).orderBy("_pos")
    running = F.sum(weight).over(local.rowsBetween(Window.unboundedPreceding, 0)) if weight else F.row_number().over(local)
    t = ranged.withColumn("_lrn", running.cast("long")).withColumn("_key", key).checkpoint()
    ends = [F.min_by("_key", "_pos").alias("_first"), F.max_by("_key", "_pos").alias("_last"), F.max_by("_lrn", "_pos").alias("_last_rows")]
    offsets, last, carry = [], None, 0
    for r in sorted(t.groupBy("_b").agg(*ends).collect(), key=lambda r: r["_b"]):
        goes_on = carry if last is not None and r["_first"] == last else 0
        offsets.append((r["_b"], r["_first"], goes_on))
        carry = r["_last_rows"] + (goes_on if r["_last"] == r["_first"] else 0)
        last = r["_last"]
    schema = StructType([StructField("_b", LongType()), StructField("_okey", t.schema["_key"].dataType), StructField("_off", LongType())])
    j = t.join(F.broadcast(spark.createDataFrame(offsets, schema)), "_b")
    rn = F.col("_lrn") + F.when(F.col("_key").eqNullSafe(F.col("_okey")), F.col("_off")).otherwise(F.lit(0))
    return j.withColumn(out, rn.cast("long")).drop("_b", "_pos", "_lrn", "_key", "_okey", "_off")


#: Rows of a group up to which one task numbers it.
GROUP_ROWS = 100_000


def number_rows(
    df: DataFrame,
    heads: DataFrame,
    key: str,
    order: list[tuple[str, bool]],
    out: str = "row_number",
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """``df`` joined with ``heads`` on ``key``, with ``ROW_NUMBER() OVER (PARTITION BY key ORDER BY order)`` of the joined rows.

    Groups of up to ``limit`` joined rows are numbered in the partitions of the join. The keys of larger ones, which are counted
    first, are few (rows / ``limit`` at most); their rows alone go through :func:`row_number_within`.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    copies = heads.groupBy(key).agg(F.count(F.lit(1)).alias("_m"))
    hot = sizes.join(copies, key).where(F.col("_n") * F.col("_m") > limit).select(key).checkpoint()
    local = Window.partitionBy(key).orderBy(*_sort_columns(order))
    number = lambda d: d.join(heads, key).withColumn(out, F.row_number().over(local).cast("long"))
    if hot.isEmpty():
        return number(df)
    large = row_number_within(df.join(hot, key, "left_semi").join(heads, key), [key], order, out=out)
    return number(df.join(hot, key, "left_anti")).unionByName(large)
