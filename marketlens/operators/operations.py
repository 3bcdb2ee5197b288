"""Delivery and seller operations: V25-V31, D3, priority sellers and the risk roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.exprs import avg_round, avg_round_if, cents, count_if, distinct_counts, is_completed, money_of, pct, ratio, round_money
from marketlens.operators.quantiles import Tiles, with_tiles
from marketlens.operators.ranking import rank_globally
from marketlens.operators.sales import completed_orders

UNKNOWN = "unknown"
# Fixed values that must equal the reference's.
MIN_VALID_DELIVERIES = 20
MIN_REVIEWED_ORDERS = 20
HIGH_VALUE_RANK = 100
RISK_SEGMENT_ORDER = ["High-Value At Risk", "High Risk", "Monitor", "Stable"]



def _valid() -> F.Column:
    return F.col("is_valid_delivery_record")


def _late() -> F.Column:
    return F.col("is_late_delivery")


def _reviewed() -> F.Column:
    return F.col("has_review_record")


def _low_review() -> F.Column:
    # "Low review" tests the rounded per-order average.
    return F.col("average_review_score") <= 2


def _delivery_aggs(with_estimated: bool = True) -> list:
    """The shared block of delivery and review metrics (valid-delivery denominators)."""
    a = [
        count_if(_valid()).alias("valid_delivery_order_count"),
        count_if(_valid() & _late()).alias("late_delivery_order_count"),
        pct(count_if(_valid() & _late()), count_if(_valid())).alias("late_delivery_rate_pct"),
        avg_round_if(_valid(), "delivery_days").alias("average_delivery_days"),
    ]
    if with_estimated:
        a.append(avg_round_if(_valid(), "estimated_delivery_days").alias("average_estimated_delivery_days"))
    return a


def _review_aggs() -> list:
    return [
        count_if(_reviewed()).alias("reviewed_order_count"),
        avg_round_if(_reviewed(), "average_review_score").alias("average_review_score"),
        count_if(_low_review()).alias("low_review_order_count"),
        pct(count_if(_low_review()), count_if(_reviewed())).alias("low_review_rate_pct"),
    ]


def seller_order_performance(order_item_detail: DataFrame, order_summary: DataFrame) -> DataFrame:
    """One row per (order, seller) of completed orders.

    Items are pre-aggregated to the (order, seller) grain before the join, so
    the join moves one row per seller-order instead of one per item.
    """
    # One row per product of a seller-order first: its lines are summed before anything else, and the
    # distinct products are then a plain count. A category belongs to its product.
    lines = order_item_detail.groupBy("order_id", "seller_id", "seller_city", "seller_state", "product_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.first(F.coalesce("product_category_name_english", F.lit(UNKNOWN))).alias("category"),
        F.sum(cents("price")).alias("price"),
        F.sum(cents("freight_value")).alias("freight"),
        F.sum(cents("gross_item_value")).alias("gross"),
        F.bool_or("shipped_after_shipping_limit").alias("late"),
    )
    soi = lines.groupBy("order_id", "seller_id", "seller_city", "seller_state").agg(
        F.sum("n").alias("item_count"),
        F.count("product_id").alias("distinct_product_count"),
        F.count_distinct("category").alias("category_count"),
        money_of(F.sum("price")).alias("item_price_total"),
        money_of(F.sum("freight")).alias("freight_total"),
        money_of(F.sum("gross")).alias("gross_item_value"),
        F.bool_or("late").alias("shipped_after_shipping_limit"),
    )
    os = completed_orders(order_summary).select(
        "order_id",
        "customer_unique_id",
        "customer_city",
        "customer_state",
        "purchase_date",
        "purchase_month",
        "carrier_handling_days",
        "delivery_days",
        "estimated_delivery_days",
        "delivery_delay_days",
        "is_late_delivery",
        "is_valid_delivery_record",
        "average_review_score",
        "has_review_record",
        "has_written_comment",
        "seller_count",
    )
    j = soi.join(os, "order_id", "inner")
    same = F.when(F.col("seller_state").isNotNull() & F.col("customer_state").isNotNull(), F.col("seller_state") == F.col("customer_state"))
    return j.select(
        "order_id",
        "seller_id",
        "seller_city",
        "seller_state",
        "customer_unique_id",
        "customer_city",
        "customer_state",
        "purchase_date",
        "purchase_month",
        "item_count",
        "distinct_product_count",
        "category_count",
        "item_price_total",
        "freight_total",
        "gross_item_value",
        "shipped_after_shipping_limit",
        "carrier_handling_days",
        "delivery_days",
        "estimated_delivery_days",
        "delivery_delay_days",
        "is_late_delivery",
        "is_valid_delivery_record",
        "average_review_score",
        "has_review_record",
        "has_written_comment",
        (F.col("seller_count") > 1).alias("is_multi_seller_order"),
        same.alias("is_same_state_delivery"),
    )


def seller_performance(seller_orders: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """One row per seller with 25+ metrics, dense revenue rank and share.

    ``seller_orders``: V25; ``items``: ``completed_items``. Both are read twice."""
    breach = F.col("shipped_after_shipping_limit")
    same = F.col("is_same_state_delivery")
    n = F.count(F.lit(1))
    sm = seller_orders.groupBy("seller_id").agg(
        F.max("seller_city").alias("seller_city"),
        F.max("seller_state").alias("seller_state"),
        n.alias("completed_order_count"),
        F.sum("item_count").alias("item_count"),
        round_money(F.sum("item_price_total")).alias("item_price_total"),
        round_money(F.sum("freight_total")).alias("freight_total"),
        round_money(F.sum("gross_item_value")).alias("gross_item_value"),
        ratio(F.sum("item_price_total"), n).alias("average_item_value_per_order"),
        ratio(F.sum("item_count"), n).alias("average_items_per_order"),
        *_delivery_aggs(with_estimated=False),
        avg_round_if(_valid(), "carrier_handling_days").alias("average_carrier_handling_days"),
        avg_round_if(_valid() & _late(), "delivery_delay_days").alias("average_delay_days_when_late"),
        count_if(breach).alias("shipping_limit_breach_count"),
        pct(count_if(breach), n).alias("shipping_limit_breach_rate_pct"),
        *_review_aggs(),
        count_if(same).alias("same_state_order_count"),
        pct(count_if(same), count_if(same.isNotNull())).alias("same_state_delivery_rate_pct"),
        F.min("purchase_date").alias("first_completed_purchase_date"),
        F.max("purchase_date").alias("last_completed_purchase_date"),
    )
    # pairs of seller and customer are counted by themselves: beside the sums, all of these would go with every pair
    customers = distinct_counts(seller_orders, ["seller_id"], {"customer_count": "customer_unique_id"}, in_turn=True).withColumnRenamed("seller_id", "_seller")
    sm = sm.join(customers, F.col("seller_id").eqNullSafe(F.col("_seller"))).drop("_seller")
    columns = ["seller_id", "seller_city", "seller_state", "completed_order_count", "customer_count"]
    sm = sm.select(*columns, *[c for c in sm.columns if c not in columns])
    catalog = distinct_counts(items, ["seller_id"], {"distinct_product_count": "product_id", "distinct_category_count": "category"}, in_turn=True)
    c = rank_globally(
        sm.join(catalog, "seller_id", "left"),
        [("item_price_total", True), ("seller_id", False)],
        dense_rank=("seller_revenue_rank", ["item_price_total"]),
        total_sum=("item_price_total", "_tot"),
        **kw,
    )
    return c.withColumn("seller_revenue_share_pct", pct("item_price_total", "_tot", 4)).drop("_tot")


def monthly_delivery(monthly_sales_df: DataFrame, order_summary: DataFrame) -> DataFrame:
    """Monthly sales calendar with delivery and review metrics."""
    d = completed_orders(order_summary).where(F.col("purchase_month").isNotNull())
    mo = d.groupBy("purchase_month").agg(
        *_delivery_aggs(),
        avg_round_if(_valid(), "carrier_handling_days").alias("average_carrier_handling_days"),
        avg_round_if(_valid(), "delivery_delay_days").alias("average_delivery_delay_days"),
        avg_round_if(_valid() & _late(), "delivery_delay_days").alias("average_delay_days_when_late"),
        *_review_aggs(),
    )
    ms = monthly_sales_df.select(
        F.col("sales_month").alias("purchase_month"),
        F.col("order_count").alias("completed_order_count"),
        "customer_count",
        "payment_value_total",
    )
    j = ms.join(mo, "purchase_month", "left")
    zero = F.lit(0)
    return j.select(
        "purchase_month",
        "completed_order_count",
        "customer_count",
        "payment_value_total",
        F.coalesce("valid_delivery_order_count", zero).alias("valid_delivery_order_count"),
        F.coalesce("late_delivery_order_count", zero).alias("late_delivery_order_count"),
        "late_delivery_rate_pct",
        "average_delivery_days",
        "average_estimated_delivery_days",
        "average_carrier_handling_days",
        "average_delivery_delay_days",
        "average_delay_days_when_late",
        F.coalesce("reviewed_order_count", zero).alias("reviewed_order_count"),
        "average_review_score",
        F.coalesce("low_review_order_count", zero).alias("low_review_order_count"),
        "low_review_rate_pct",
    )


def state_delivery(order_summary: DataFrame) -> DataFrame:
    """Completed orders per destination state (NULL state -> 'unknown')."""
    d = completed_orders(order_summary).withColumn("customer_state", F.coalesce("customer_state", F.lit(UNKNOWN)))
    ip = F.coalesce("item_price_total", F.lit(0))
    fr = F.coalesce("freight_total", F.lit(0))
    sums = d.groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("completed_order_count"),
        round_money(F.sum("payment_value_total")).alias("payment_value_total"),
        round_money(F.sum(fr)).alias("freight_total"),
        pct(F.sum(fr), F.sum(ip + fr)).alias("freight_share_pct"),
        *_delivery_aggs(),
        avg_round_if(_valid(), "delivery_delay_days").alias("average_delivery_delay_days"),
        avg_round_if(_valid() & _late(), "delivery_delay_days").alias("average_delay_days_when_late"),
        *_review_aggs(),
    )
    # by themselves, as in ``seller_performance``
    customers = distinct_counts(d, ["customer_state"], {"customer_count": "customer_unique_id"})
    first, *rest = sums.columns[1:]
    return sums.join(customers, "customer_state").select("customer_state", first, "customer_count", *rest)


def operations_kpis(order_summary: DataFrame, seller_orders: DataFrame) -> DataFrame:
    """One row: order-level delivery KPIs next to seller-order KPIs."""
    d = completed_orders(order_summary)
    om = d.agg(
        F.count(F.lit(1)).alias("completed_order_count"),
        *_delivery_aggs(),
        avg_round_if(_valid(), "carrier_handling_days").alias("average_carrier_handling_days"),
        avg_round_if(_valid(), "delivery_delay_days").alias("average_delivery_delay_days"),
        avg_round_if(_valid() & _late(), "delivery_delay_days").alias("average_delay_days_when_late"),
        *_review_aggs(),
    )
    breach = F.col("shipped_after_shipping_limit")
    same = F.col("is_same_state_delivery")
    n = F.count(F.lit(1))
    som = seller_orders.agg(
        n.alias("seller_order_count"),
        count_if(breach).alias("shipping_limit_breach_count"),
        pct(count_if(breach), n).alias("shipping_limit_breach_rate_pct"),
        count_if(same).alias("same_state_seller_order_count"),
        pct(count_if(same), count_if(same.isNotNull())).alias("same_state_delivery_rate_pct"),
    )
    return om.crossJoin(som)  # 1 x 1


def delivery_status_expr() -> F.Column:
    # CASE WHEN is_late THEN 'Late' ELSE ...: NULL goes to the ELSE branch (trap T14).
    return F.when(F.coalesce(_late(), F.lit(False)), "Late").otherwise("On Time or Early")


def delivery_review_impact(order_summary: DataFrame) -> DataFrame:
    """Valid completed deliveries, Late vs On Time or Early."""
    d = completed_orders(order_summary).where(_valid())
    wc = F.col("has_written_comment")
    return d.groupBy(delivery_status_expr().alias("delivery_status")).agg(
        F.count(F.lit(1)).alias("order_count"),
        count_if(_reviewed()).alias("reviewed_order_count"),
        avg_round("delivery_days").alias("average_delivery_days"),
        avg_round("delivery_delay_days").alias("average_delivery_delay_days"),
        avg_round_if(_reviewed(), "average_review_score").alias("average_review_score"),
        count_if(_low_review()).alias("low_review_order_count"),
        pct(count_if(_low_review()), count_if(_reviewed())).alias("low_review_rate_pct"),
        count_if(wc).alias("written_comment_order_count"),
        pct(count_if(wc), count_if(_reviewed())).alias("written_comment_rate_pct"),
    )


RISK_COLUMNS = [
    "seller_id",
    "seller_city",
    "seller_state",
    "completed_order_count",
    "customer_count",
    "item_count",
    "item_price_total",
    "valid_delivery_order_count",
    "late_delivery_rate_pct",
    "average_delivery_days",
    "shipping_limit_breach_rate_pct",
    "reviewed_order_count",
    "average_review_score",
    "low_review_rate_pct",
    "seller_revenue_rank",
    "seller_revenue_share_pct",
]


def seller_risk(seller_perf: DataFrame, high_value_rank: int = HIGH_VALUE_RANK) -> DataFrame:
    """Quartile-based operational risk for sellers with enough history.

    The borders of the three NTILE(4) come from shared histogram scans; quartile 4 is the worst.
    """
    e = seller_perf.where(
        (F.col("valid_delivery_order_count") >= MIN_VALID_DELIVERIES) & (F.col("reviewed_order_count") >= MIN_REVIEWED_ORDERS)
    ).select(*RISK_COLUMNS)
    e = with_tiles(
        e,
        {
            "late_delivery_quartile": Tiles("late_delivery_rate_pct", "seller_id", 4),
            "shipping_breach_quartile": Tiles("shipping_limit_breach_rate_pct", "seller_id", 4),
            "low_review_quartile": Tiles("low_review_rate_pct", "seller_id", 4),
        },
    )
    e = e.withColumn(
        "operational_risk_score", F.col("late_delivery_quartile") + F.col("shipping_breach_quartile") + F.col("low_review_quartile")
    )
    hv = F.col("seller_revenue_rank") <= high_value_rank
    score = F.col("operational_risk_score")
    seg = F.when((score >= 10) & hv, "High-Value At Risk").when(score >= 10, "High Risk").when(score >= 7, "Monitor").otherwise("Stable")
    return e.withColumns({"is_high_value_seller": hv, "seller_risk_segment": seg})


def priority_sellers(risk: DataFrame) -> DataFrame:
    """Non-Stable sellers, most urgent first."""
    return risk.where(F.col("seller_risk_segment") != "Stable").orderBy(
        F.desc("is_high_value_seller"), F.desc("operational_risk_score"), F.desc("item_price_total"), F.asc("seller_id")
    )


def risk_segment_summary(risk: DataFrame) -> DataFrame:
    """Roll-up per risk segment."""
    return risk.groupBy("seller_risk_segment").agg(
        F.count(F.lit(1)).alias("seller_count"),
        count_if(F.col("is_high_value_seller")).alias("high_value_seller_count"),
        avg_round("late_delivery_rate_pct").alias("average_late_delivery_rate_pct"),
        avg_round("low_review_rate_pct").alias("average_low_review_rate_pct"),
        round_money(F.sum("item_price_total")).alias("item_price_total"),
    )


def top_sellers(seller_perf: DataFrame, k: int = 10) -> DataFrame:
    """O2: the k sellers with the largest revenue."""
    columns = [
        "seller_id", "seller_state", "completed_order_count", "customer_count", "item_price_total", "late_delivery_rate_pct",
        "shipping_limit_breach_rate_pct", "average_review_score", "low_review_rate_pct", "seller_revenue_rank",
    ]
    return seller_perf.select(*columns).orderBy(F.desc("item_price_total"), "seller_id").limit(k)


def recent_delivery(monthly: DataFrame, k: int = 12) -> DataFrame:
    """O2: the last k months of delivery performance, latest first."""
    columns = [
        "purchase_month", "completed_order_count", "late_delivery_rate_pct", "average_delivery_days", "average_delay_days_when_late",
        "average_review_score", "low_review_rate_pct",
    ]
    return monthly.select(*columns).orderBy(F.desc("purchase_month")).limit(k)


def states_by_late_rate(states: DataFrame, min_orders: int = 100) -> DataFrame:
    """States with at least ``min_orders`` completed orders, highest late rate first."""
    columns = [
        "customer_state", "completed_order_count", "customer_count", "freight_share_pct", "late_delivery_rate_pct", "average_delivery_days",
        "average_delay_days_when_late", "average_review_score", "low_review_rate_pct",
    ]
    return states.where(F.col("completed_order_count") >= min_orders).select(*columns).orderBy(F.desc("late_delivery_rate_pct"), "customer_state")


def late_rate(order_summary: DataFrame) -> DataFrame:
    """D3: late-delivery rate over valid delivery records."""
    d = order_summary.where(_valid())
    return d.agg(pct(count_if(_late()), F.count(F.lit(1))).alias("late_delivery_rate_pct"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("DataFrame", "F", "is_completed")]
