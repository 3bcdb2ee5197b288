"""Sales analytics: V19-V23 plus the documented queries D1, D2 and the top-k export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.exprs import avg_money, avg_round, distinct_counts, is_completed, money, money_sum, pct, ratio, round_money
from marketlens.operators.customers import _month_calendar, growth_pct
from marketlens.operators.ranking import rank_globally

# Fixed values that must equal the reference's: concentration thresholds (%).
CONCENTRATION_THRESHOLDS = [50, 80, 90, 95]
UNKNOWN = "unknown"


def completed_orders(order_summary: DataFrame) -> DataFrame:
    """Delivered and paid orders; the filter sits under every aggregate below."""
    return order_summary.where(is_completed())


def monthly_sales(order_summary: DataFrame) -> DataFrame:
    """Gap-filled monthly sales of completed orders with MoM payment growth."""
    done = completed_orders(order_summary).where(F.col("purchase_date").isNotNull())
    c = done.select(
        F.trunc("purchase_date", "month").alias("sales_month"),
        "order_id",
        "customer_unique_id",
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
        F.coalesce("item_price_total", F.lit(0)).alias("item_price_total"),
        F.coalesce("freight_total", F.lit(0)).alias("freight_total"),
        "payment_value_total",
    )
    m = c.groupBy("sales_month").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum("item_count").alias("item_count"),
        round_money(F.sum("item_price_total")).alias("item_price_total"),
        round_money(F.sum("freight_total")).alias("freight_total"),
        round_money(F.sum(F.col("item_price_total") + F.col("freight_total"))).alias("item_and_freight_total"),
        round_money(F.sum("payment_value_total")).alias("payment_value_total"),
    )
    # pairs of month and customer by themselves: beside the sums, all of these would go with every pair
    m = m.join(distinct_counts(c, ["sales_month"], {"customer_count": "customer_unique_id"}), "sales_month")
    bounds = c.agg(F.min("sales_month").alias("lo"), F.max("sales_month").alias("hi"))
    cal = _month_calendar(bounds, "lo", "hi", "sales_month")
    zero = F.lit(0)
    f = cal.join(m, "sales_month", "left").select(
        "sales_month",
        F.coalesce("order_count", zero).alias("order_count"),
        F.coalesce("customer_count", zero).alias("customer_count"),
        F.coalesce("item_count", zero).alias("item_count"),
        F.coalesce("item_price_total", zero).alias("item_price_total"),
        F.coalesce("freight_total", zero).alias("freight_total"),
        F.coalesce("item_and_freight_total", zero).alias("item_and_freight_total"),
        F.coalesce("payment_value_total", zero).alias("payment_value_total"),
    )
    # LAG over the calendar: one row per month, bounded by the date span.
    f = f.withColumn("_prev", F.lag("payment_value_total").over(Window.orderBy("sales_month")))
    return f.select(
        "sales_month",
        "order_count",
        "customer_count",
        "item_count",
        "item_price_total",
        "freight_total",
        "item_and_freight_total",
        "payment_value_total",
        ratio("payment_value_total", "order_count").alias("average_order_value"),
        pct("freight_total", "item_and_freight_total").alias("freight_share_pct"),
        round_money(F.col("payment_value_total") - F.col("item_and_freight_total")).alias("payment_difference"),
        growth_pct("payment_value_total", "_prev").alias("payment_growth_pct"),
    )


def completed_items(order_items: DataFrame, order_summary: DataFrame, products: DataFrame) -> DataFrame:
    """Items of completed orders with customer, date and English category: what the category, product and
    seller reports need of an item. Land it once and hand it to them."""
    done = completed_orders(order_summary).select("order_id", "customer_unique_id", "purchase_date")
    p = products.select("product_id", "product_category_name_english")
    return (
        order_items.join(done, "order_id", "inner")
        .join(p, "product_id", "left")
        .select(
            "order_id", "product_id", "seller_id", "customer_unique_id", "purchase_date", "price", "freight_value",
            F.coalesce("product_category_name_english", F.lit(UNKNOWN)).alias("category"),
        )
    )


def category_performance(items: DataFrame, **kw) -> DataFrame:
    """One row per English category with revenue share and dense revenue rank.

    ``items``: the landed ``completed_items``."""
    sums = items.groupBy("category").agg(
        F.count(F.lit(1)).alias("item_count"),
        money_sum("price").alias("item_price_total"),
        money_sum("freight_value").alias("freight_total"),
        money_sum(F.col("price") + F.col("freight_value")).alias("item_and_freight_total"),
        avg_money("price").alias("average_item_price"),
    )
    distinct = {"order_count": "order_id", "product_count": "product_id", "seller_count": "seller_id", "customer_count": "customer_unique_id"}
    g = sums.join(distinct_counts(items, ["category"], distinct, in_turn=True), "category").withColumnRenamed("category", "product_category_name_english")
    g = rank_globally(
        g,
        [("item_price_total", True), ("product_category_name_english", False)],
        dense_rank=("item_revenue_rank", ["item_price_total"]),
        total_sum=("item_price_total", "_tot"),
        **kw,
    )
    return g.select(
        "product_category_name_english",
        "order_count",
        "item_count",
        "product_count",
        "seller_count",
        "customer_count",
        "item_price_total",
        "freight_total",
        "item_and_freight_total",
        "average_item_price",
        ratio("item_count", "order_count").alias("average_items_per_order"),
        pct("freight_total", "item_and_freight_total").alias("freight_share_pct"),
        pct("item_price_total", "_tot").alias("item_revenue_share_pct"),
        "item_revenue_rank",
    )


PRODUCT_COLUMNS = [
    "product_id",
    "product_category_name_english",
    "order_count",
    "item_count",
    "customer_count",
    "seller_count",
    "item_price_total",
    "freight_total",
    "average_item_price",
    "minimum_item_price",
    "maximum_item_price",
    "first_purchase_date",
    "last_purchase_date",
    "item_revenue_rank",
    "item_revenue_share_pct",
    "cumulative_item_revenue_pct",
]


def product_ranked(items: DataFrame, **kw) -> DataFrame:
    """V21 plus product_position / total_product_count (used by V23).

    ``items``: the landed ``completed_items``."""
    key = ["product_id", "category"]
    sums = items.groupBy(*key).agg(
        F.count(F.lit(1)).alias("item_count"),
        money_sum("price").alias("item_price_total"),
        money_sum("freight_value").alias("freight_total"),
        avg_money("price").alias("average_item_price"),
        round_money(F.min("price")).alias("minimum_item_price"),
        round_money(F.max("price")).alias("maximum_item_price"),
        F.min("purchase_date").alias("first_purchase_date"),
        F.max("purchase_date").alias("last_purchase_date"),
    )
    distinct = {"order_count": "order_id", "customer_count": "customer_unique_id", "seller_count": "seller_id"}
    g = sums.join(distinct_counts(items, key, distinct, in_turn=True), key).withColumnRenamed("category", "product_category_name_english")
    # Dense rank, running sum, row number and count in one distributed ranking.
    g = rank_globally(
        g,
        [("item_price_total", True), ("product_id", False)],
        row_number="product_position",
        dense_rank=("item_revenue_rank", ["item_price_total"]),
        running_sum=("item_price_total", "_cum"),
        total_count="total_product_count",
        total_sum=("item_price_total", "_tot"),
        **kw,
    )
    return g.withColumns(
        {
            "item_revenue_share_pct": pct("item_price_total", "_tot", 4),
            "cumulative_item_revenue_pct": pct("_cum", "_tot", 2),
        }
    )


def product_performance(items: DataFrame, **kw) -> DataFrame:
    """One row per product with dense rank, share and cumulative share."""
    return product_ranked(items, **kw).select(*PRODUCT_COLUMNS)


def top_products(product_perf: DataFrame, k: int = 20) -> DataFrame:
    """Top-k products by revenue (TakeOrderedAndProject; k is the feature)."""
    return product_perf.orderBy(F.desc("item_price_total"), F.asc("product_id")).limit(k)


def preview_products(product_perf: DataFrame, k: int = 10) -> DataFrame:
    """O2: the k products with the largest revenue, short columns."""
    columns = [
        "product_id", "product_category_name_english", "order_count", "item_count", "item_price_total", "item_revenue_share_pct",
        "cumulative_item_revenue_pct", "item_revenue_rank",
    ]
    return top_products(product_perf, k).select(*columns)


def revenue_concentration(ranked: DataFrame, thresholds: list[int] | None = None) -> DataFrame:
    """Fewest top products whose *rounded* cumulative share reaches each threshold.

    All thresholds are answered in one pass with conditional minima (no
    cross join that would multiply the product table), then unpivoted.
    """
    thresholds = thresholds or CONCENTRATION_THRESHOLDS
    aggs = [F.max("total_product_count").alias("total_product_count")]
    for t in thresholds:
        aggs.append(F.min(F.when(F.col("cumulative_item_revenue_pct") >= t, F.col("product_position"))).alias(f"t{t}"))
    one = ranked.agg(*aggs)
    rows = F.explode(
        F.array(*[F.struct(F.lit(t).cast("decimal(5,2)").alias("threshold_pct"), F.col(f"t{t}").alias("products_required")) for t in thresholds])
    )
    out = one.select("total_product_count", rows.alias("r")).select("r.*", "total_product_count")
    return out.select(
        "threshold_pct",
        "products_required",
        "total_product_count",
        pct("products_required", "total_product_count").alias("product_share_required_pct"),
    )


def sales_kpis(order_summary: DataFrame) -> DataFrame:
    """One row of completed-order sales KPIs."""
    d = completed_orders(order_summary)
    ip = F.coalesce("item_price_total", F.lit(0))
    fr = F.coalesce("freight_total", F.lit(0))
    n = F.count(F.lit(1))
    return d.agg(
        n.alias("completed_order_count"),
        F.count_distinct("customer_unique_id").alias("completed_customer_count"),
        F.sum(F.coalesce("item_count", F.lit(0))).alias("item_count"),
        round_money(F.sum(ip)).alias("item_price_total"),
        round_money(F.sum(fr)).alias("freight_total"),
        round_money(F.sum(ip + fr)).alias("item_and_freight_total"),
        round_money(F.sum("payment_value_total")).alias("payment_value_total"),
        avg_round("payment_value_total").alias("average_order_value"),
        ratio(F.sum(F.coalesce("item_count", F.lit(0))), n).alias("average_items_per_order"),
        pct(F.sum(fr), F.sum(ip + fr)).alias("freight_share_pct"),
        round_money(F.sum("payment_value_total") - F.sum(ip + fr)).alias("payment_difference"),
        F.min("purchase_date").alias("first_completed_purchase_date"),
        F.max("purchase_date").alias("last_completed_purchase_date"),
    )


def monthly_order_performance(order_summary: DataFrame) -> DataFrame:
    """All statuses, per purchase month: orders, distinct customers, payment."""
    return order_summary.groupBy("purchase_month").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.count_distinct("customer_unique_id").alias("customer_count"),
        F.sum("payment_value_total").alias("total_payment_value"),
    )


def category_items_all(order_item_detail: DataFrame) -> DataFrame:
    """All statuses, per category: items, price and freight totals."""
    return order_item_detail.groupBy("product_category_name_english").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum("price").alias("product_revenue"),
        F.sum("freight_value").alias("freight_value"),
    )
