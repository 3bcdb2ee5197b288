"""Grain-safe order and item models.

Each one-to-many child (items, payments, reviews) is aggregated to one row
per ``order_id`` *before* it is joined, so totals cannot fan out. All three
aggregates and the order table are hash-partitioned on ``order_id``; the
left-join chain therefore runs as sort-merge joins over one shared key, with
the partial (map-side) aggregation done before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.exprs import cents, day_diff, money, money_of, money_sum, ratio


def order_items_agg(order_items: DataFrame) -> DataFrame:
    """One row per order with item totals.

    Each distinct count groups its column with the order first, so a hot order is many small groups, and items that lie
    in buckets of the order stay there (one aggregate with two distincts would deal its multiplied rows anew). Sums stay LONG cents
    until the order's: there are nearly as many products of orders as items.
    """
    products = order_items.groupBy("order_id", "product_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cents("price")).alias("price"),
        F.sum(cents("freight_value")).alias("freight"),
        F.sum(cents("price") + cents("freight_value")).alias("gross"),
    )
    totals = products.groupBy("order_id").agg(
        F.sum("n").cast("int").alias("item_count"),
        F.count("product_id").cast("int").alias("distinct_product_count"),
        money(money_of(F.sum("price"))).alias("item_price_total"),
        money(money_of(F.sum("freight"))).alias("freight_total"),
        money(money_of(F.sum("gross"))).alias("gross_item_value"),
    )
    sellers = order_items.select("order_id", "seller_id").distinct().groupBy("order_id").agg(F.count("seller_id").cast("int").alias("seller_count"))
    return totals.join(sellers, "order_id").select(
        "order_id", "item_count", "distinct_product_count", "seller_count", "item_price_total", "freight_total", "gross_item_value"
    )


def _sorted_list(values) -> F.Column:
    return F.when(F.size(values) > 0, F.array_join(F.array_sort(values), ", "))


def payments_agg(payments: DataFrame) -> DataFrame:
    """One row per order with payment totals and the sorted type list."""
    return payments.groupBy("order_id").agg(
        F.count(F.lit(1)).cast("int").alias("payment_record_count"),
        F.count_distinct("payment_type").cast("int").alias("payment_type_count"),
        money(money_sum("payment_value")).alias("payment_value_total"),
        F.max("payment_installments").alias("maximum_installments"),
        # STRING_AGG(DISTINCT t, ', ' ORDER BY t): NULL when no value (trap T7).
        # The distinct set per order is bounded by the number of payment types.
        _sorted_list(F.collect_set("payment_type")).alias("payment_types"),
        F.bool_or(F.col("payment_type") == "credit_card").alias("uses_credit_card"),
        F.bool_or(F.col("payment_type") == "voucher").alias("uses_voucher"),
    )


def reviews_agg(reviews: DataFrame) -> DataFrame:
    """One row per order with review metrics."""
    msg = F.col("review_comment_message")
    return reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).cast("int").alias("review_record_count"),
        ratio(F.sum("review_score"), F.count("review_score"), 2).alias("average_review_score"),
        F.min("review_score").alias("minimum_review_score"),
        F.max("review_score").alias("maximum_review_score"),
        F.min("review_creation_date").alias("first_review_date"),
        F.max("review_answer_timestamp").alias("latest_review_answer"),
        F.bool_or(msg.isNotNull() & (F.trim(msg) != "")).alias("has_written_comment"),
    )


def _order_dates(purchase: str = "order_purchase_timestamp") -> dict:
    p = F.col(purchase)
    return {
        "purchase_date": F.to_date(p),
        "purchase_month": F.trunc(p, "month"),
        "purchase_year": F.year(p).cast("short"),
    }


def _delivery_columns() -> dict:
    d = F.col("order_delivered_customer_date")
    e = F.col("order_estimated_delivery_date")
    p = F.col("order_purchase_timestamp")
    return {
        "delivery_days": F.when(d.isNotNull(), day_diff(d, p)),
        "delivery_delay_days": F.when(d.isNotNull(), day_diff(d, e)),
        "is_late_delivery": F.when(d.isNotNull(), F.to_date(d) > F.to_date(e)),
    }


CUSTOMER_COLUMNS = ["customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"]


def order_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """The customer columns of each order, by ``order_id``."""
    c = customers.select("customer_id", *CUSTOMER_COLUMNS)
    return orders.select("order_id", "customer_id").join(c, "customer_id", "left").select("order_id", *CUSTOMER_COLUMNS)


#: Rows of a dimension (three or four short texts) up to which it is broadcast: some 100 MB a machine.
BROADCAST_ROWS = 1_000_000
PRODUCT_COLUMNS = ["product_id", "product_category_name", "product_category_name_english"]
SELLER_COLUMNS = ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"]


def dimensions(products: DataFrame, sellers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the models read of two landed dimensions, with a broadcast hint if they are counted and found small: a shuffled
    join deals out the items with all their columns, and deals them back by the order."""
    narrow = products.select(*PRODUCT_COLUMNS), sellers.select(*SELLER_COLUMNS)
    return tuple(F.broadcast(df) if df.count() <= BROADCAST_ROWS else df for df in narrow)


def _with_customer(df: DataFrame, customers: DataFrame) -> DataFrame:
    """Customer columns joined by order (``order_customers``) or else by customer."""
    key = "order_id" if "order_id" in customers.columns else "customer_id"
    return df.join(customers.select(key, *CUSTOMER_COLUMNS), key, "left")


def order_summary(
    orders: DataFrame, customers: DataFrame, order_items: DataFrame, payments: DataFrame, reviews: DataFrame
) -> DataFrame:
    """One row per order, 51 columns. ``customers``: the table, or ``order_customers``."""
    oi = order_items_agg(order_items).withColumn("_oi", F.lit(True))
    pa = payments_agg(payments).withColumn("_pa", F.lit(True))
    ra = reviews_agg(reviews).withColumn("_ra", F.lit(True))
    j = _with_customer(orders, customers).join(oi, "order_id", "left").join(pa, "order_id", "left").join(ra, "order_id", "left")

    p = F.col("order_purchase_timestamp")
    a = F.col("order_approved_at")
    car = F.col("order_delivered_carrier_date")
    dates = _order_dates()
    deliv = _delivery_columns()
    approval_us = F.timestamp_diff("MICROSECOND", p, a)
    return j.select(
        "order_id",
        "customer_id",
        "customer_unique_id",
        "customer_zip_code_prefix",
        "customer_city",
        "customer_state",
        "order_status",
        "order_purchase_timestamp",
        dates["purchase_date"].alias("purchase_date"),
        dates["purchase_month"].alias("purchase_month"),
        dates["purchase_year"].alias("purchase_year"),
        F.quarter(p).cast("short").alias("purchase_quarter"),
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
        F.when(a.isNotNull(), ratio(approval_us, F.lit(3600 * 10**6), 2)).alias("approval_hours"),
        F.when(car.isNotNull(), day_diff(car, p)).alias("carrier_handling_days"),
        deliv["delivery_days"].alias("delivery_days"),
        day_diff("order_estimated_delivery_date", p).alias("estimated_delivery_days"),
        deliv["delivery_delay_days"].alias("delivery_delay_days"),
        deliv["is_late_delivery"].alias("is_late_delivery"),
        (F.col("order_status") == "canceled").alias("is_canceled"),
        F.col("order_delivered_customer_date").isNotNull().alias("is_delivered"),
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
        F.coalesce("distinct_product_count", F.lit(0)).alias("distinct_product_count"),
        F.coalesce("seller_count", F.lit(0)).alias("seller_count"),
        "item_price_total",
        "freight_total",
        "gross_item_value",
        F.coalesce("payment_record_count", F.lit(0)).alias("payment_record_count"),
        F.coalesce("payment_type_count", F.lit(0)).alias("payment_type_count"),
        "payment_value_total",
        "maximum_installments",
        "payment_types",
        "uses_credit_card",
        "uses_voucher",
        F.coalesce("review_record_count", F.lit(0)).alias("review_record_count"),
        "average_review_score",
        "minimum_review_score",
        "maximum_review_score",
        "first_review_date",
        "latest_review_answer",
        "has_written_comment",
        money(F.col("payment_value_total") - F.col("gross_item_value"), 16).alias("payment_difference"),
        F.col("_oi").isNotNull().alias("has_item_record"),
        F.col("_pa").isNotNull().alias("has_payment_record"),
        F.col("_ra").isNotNull().alias("has_review_record"),
        "has_timestamp_anomaly",
        "has_status_date_mismatch",
        "is_valid_delivery_record",
    )


def order_item_detail(
    order_items: DataFrame, orders: DataFrame, customers: DataFrame, products: DataFrame, sellers: DataFrame
) -> DataFrame:
    """One row per order item with order, customer, product and seller context.

    ``products`` and ``sellers`` are dimensions; they are left-joined without a
    hint so AQE can broadcast them when their runtime size is under the
    threshold and fall back to sort-merge when it is not.
    """
    o = orders.select(
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
        "has_timestamp_anomaly",
        "has_status_date_mismatch",
        "is_valid_delivery_record",
    )
    p = products.select(*PRODUCT_COLUMNS)
    s = sellers.select(*SELLER_COLUMNS)
    # the customer joins the order, of which there are fewer than items
    j = order_items.join(_with_customer(o, customers), "order_id", "left").join(p, "product_id", "left").join(s, "seller_id", "left")
    dates = _order_dates()
    deliv = _delivery_columns()
    car = F.col("order_delivered_carrier_date")
    return j.select(
        "order_id",
        "order_item_id",
        "customer_id",
        "customer_unique_id",
        "customer_zip_code_prefix",
        "customer_city",
        "customer_state",
        "order_status",
        "order_purchase_timestamp",
        dates["purchase_date"].alias("purchase_date"),
        dates["purchase_month"].alias("purchase_month"),
        dates["purchase_year"].alias("purchase_year"),
        "product_id",
        "product_category_name",
        "product_category_name_english",
        "seller_id",
        "seller_zip_code_prefix",
        "seller_city",
        "seller_state",
        "shipping_limit_date",
        "price",
        "freight_value",
        money(F.col("price") + F.col("freight_value")).alias("gross_item_value"),
        F.when(car.isNotNull(), car > F.col("shipping_limit_date")).alias("shipped_after_shipping_limit"),
        deliv["delivery_days"].alias("delivery_days"),
        deliv["delivery_delay_days"].alias("delivery_delay_days"),
        deliv["is_late_delivery"].alias("is_late_delivery"),
        "has_timestamp_anomaly",
        "has_status_date_mismatch",
        "is_valid_delivery_record",
    )
