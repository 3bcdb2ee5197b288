"""Order-free fingerprints of row multisets: does a model hold its source's rows?

Totals agree when two rows have swapped values; fingerprints don't. Every row of a side becomes a 128-bit digest of its
values, and a range of keys the number of its rows and the sum of their digests, whatever their order; repeated rows count as
often as they stand. A side is one hash aggregation with partial sums, of ``RANGES`` rows a check. Only ranges that
differ are looked at again, key by key, so a fault is named with its key at the cost of one more scan of both sides.

Digests are taken of the values as they are, not of their text, and summed as LONGs: making texts of dates and numbers,
MD5 of them and DECIMAL sums took most of the time of a comparison.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType, StructField

RANGES = 1024
#: 32-bit parts of a row's digest; 2^31 rows a range are summed as LONGs before an overflow, which raises.
LIMBS = "abcd"


@dataclass(frozen=True)
class Pair:
    """Two frames that must hold the same rows: the key and the compared columns, by the same names and types."""

    name: str
    key: str
    source: DataFrame
    model: DataFrame


def _value(f: StructField) -> Column:
    """The value as the hash takes it: whole numbers of any width alike, one zero."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (ByteType, ShortType, IntegerType)):
        return c.cast("long")
    return c + F.lit(0.0) if isinstance(f.dataType, (DoubleType, FloatType)) else c


def _limbs(df: DataFrame, key: str) -> DataFrame:
    """``key`` (text), its range, and the row's digest, two XXH64 of different seeds, as four whole numbers below 2^32.

    A hash passes over NULLs, so every value is followed by whether it is one."""
    parts = [x for f in df.schema.fields for x in (_value(f), F.col(f"`{f.name}`").isNull())]
    name = F.col(key).cast("string")
    hashed = df.select(
        name.alias("key"), F.pmod(F.xxhash64(name), F.lit(RANGES)).cast("int").alias("range"), F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit(len(parts)), *parts).alias("g")
    )
    low, high = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), lambda c: F.shiftrightunsigned(c, 32)
    return hashed.select("key", "range", low("h").alias("a"), high("h").alias("b"), low("g").alias("c"), high("g").alias("d"))


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in LIMBS])


def _sides(pairs: list[Pair], limbs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    parts = []
    for p in pairs:
        for side, rows in zip(("source", "model"), limbs[p.name], strict=True):
            parts.append(rows.withColumns({"check_name": F.lit(p.name), "side": F.lit(side)}))
    return reduce(DataFrame.unionByName, parts)


def _compared(sums: DataFrame, by: list[str]) -> DataFrame:
    """Both sides' sums next to each other, and whether they differ."""
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    wide = sums.groupBy(*by).agg(*[of(side, c).alias(f"{side}_{c}") for side in ("source", "model") for c in "n" + LIMBS])
    return wide.withColumn("differs", _differs())


def _differs() -> Column:
    return ~reduce(lambda x, y: x & y, [F.col(f"source_{c}").eqNullSafe(F.col(f"model_{c}")) for c in "n" + LIMBS])


def range_sums(pairs: list[Pair]) -> DataFrame:
    """``check_name, range`` and both sides' rows and digest sums, with ``differs``."""
    limbs = {p.name: (_limbs(p.source, p.key), _limbs(p.model, p.key)) for p in pairs}
    return _compared(_sums(_sides(pairs, limbs), "check_name", "side", "range"), ["check_name", "range"])


def differing_keys(pairs: list[Pair], ranges: dict[str, list[int]]) -> DataFrame | None:
    """``check_name, key, source_rows, model_rows`` of the keys whose rows differ, looked for in the given ranges of each check."""
    open_ = [p for p in pairs if ranges.get(p.name)]
    if not open_:
        return None
    keys = reduce(DataFrame.unionByName, [_differing(p, ranges[p.name]) for p in open_])
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return keys.select("check_name", "key", count("source_n").alias("source_rows"), count("model_n").alias("model_rows"))


def _differing(pair: Pair, ranges: list[int]) -> DataFrame:
    """The keys of one check whose sums differ. Both sides are grouped and joined by the key, so a side that lies in buckets
    of it isn't shuffled; NULL keys don't meet in a join and are summed apart."""
    limbs = [_limbs(df, pair.key) for df in (pair.source, pair.model)]
    if len(ranges) < RANGES:
        limbs = [rows.where(F.col("range").isin(ranges)) for rows in limbs]
    named = lambda side, rows, *by: _sums(rows, *by).withColumnsRenamed({c: f"{side}_{c}" for c in "n" + LIMBS})
    source, model = (named(side, rows.where(F.col("key").isNotNull()), "key") for side, rows in zip(("source", "model"), limbs, strict=True))
    keyed = source.join(model, "key", "full_outer")
    source, model = (named(side, rows.where(F.col("key").isNull())) for side, rows in zip(("source", "model"), limbs, strict=True))
    nulls = source.crossJoin(model).select(F.lit(None).cast("string").alias("key"), *keyed.columns[1:])  # one row each
    return keyed.unionByName(nulls).where(_differs()).withColumn("check_name", F.lit(pair.name))


def compare(pairs: list[Pair]) -> tuple[DataFrame, DataFrame | None]:
    """A row a check (``check_name, source_rows, model_rows, differing_keys, passed``), and the keys that differ (None: none do).

    The range sums come to the driver only where they differ (at most ``RANGES`` a check); they say what to scan again.
    """
    sums = range_sums(pairs)
    spark = sums.sparkSession
    totals = sums.groupBy("check_name").agg(
        F.coalesce(F.sum("source_n"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("model_n"), F.lit(0)).alias("model_rows"),
        F.collect_list(F.when(F.col("differs"), F.col("range"))).alias("ranges"),
    )
    found = {r.check_name: r for r in totals.collect()}
    keys = differing_keys(pairs, {name: r.ranges for name, r in found.items()})
    rows = [(p.name, found[p.name].source_rows if p.name in found else 0, found[p.name].model_rows if p.name in found else 0) for p in pairs]
    report = spark.createDataFrame(rows, "check_name string, source_rows long, model_rows long")
    if keys is None:
        counted = report.withColumn("differing_keys", F.lit(0).cast("long"))
    else:
        n = keys.groupBy("check_name").agg(F.count(F.lit(1)).alias("differing_keys"))
        counted = report.join(n, "check_name", "left").withColumn("differing_keys", F.coalesce("differing_keys", F.lit(0).cast("long")))
    return counted.withColumn("passed", F.col("differing_keys") == 0), keys


def _money(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("decimal(18,2)")


def model_pairs(clean: dict[str, DataFrame], order_summary: DataFrame, order_item_detail: DataFrame, activity: DataFrame) -> list[Pair]:
    """The models beside their sources, each side at the same grain."""
    items, pays, revs, orders = clean["order_items"], clean["payments"], clean["reviews"], clean["orders"]
    line = ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"]
    head = ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_delivered_customer_date", "is_valid_delivery_record"]
    n = F.count(F.lit(1)).cast("long")
    having = lambda flag: order_summary.where(flag)
    by_month = orders.join(clean["customers"].select("customer_id", "customer_unique_id"), "customer_id", "left").groupBy(
        "customer_unique_id", F.trunc("order_purchase_timestamp", "month").alias("activity_month")
    )
    return [
        Pair("items_in_item_detail", "order_id", items.select(*line), order_item_detail.select(*line)),
        Pair("orders_in_order_summary", "order_id", orders.select(*head), order_summary.select(*head)),
        Pair(
            "item_totals_of_orders",
            "order_id",
            items.groupBy("order_id").agg(n.alias("n"), _money(F.sum("price")).alias("price"), _money(F.sum("freight_value")).alias("freight")),
            having("has_item_record").select("order_id", F.col("item_count").cast("long").alias("n"), _money("item_price_total").alias("price"), _money("freight_total").alias("freight")),
        ),
        Pair(
            "payment_totals_of_orders",
            "order_id",
            pays.groupBy("order_id").agg(n.alias("n"), _money(F.sum("payment_value")).alias("paid")),
            having("has_payment_record").select("order_id", F.col("payment_record_count").cast("long").alias("n"), _money("payment_value_total").alias("paid")),
        ),
        Pair(
            "review_counts_of_orders",
            "order_id",
            revs.groupBy("order_id").agg(n.alias("n"), F.min("review_score").cast("long").alias("low")),
            having("has_review_record").select("order_id", F.col("review_record_count").cast("long").alias("n"), F.col("minimum_review_score").cast("long").alias("low")),
        ),
        Pair(
            "months_of_customers",
            "customer_unique_id",
            by_month.agg(n.alias("n")),
            activity.select("customer_unique_id", "activity_month", F.col("monthly_order_count").cast("long").alias("n")),
        ),
    ]
