"""Customer analytics: V08-V10, V16, V17 and the cohort views V11, V12, V18.

The customer key is ``customer_unique_id`` (a person); ``customer_id`` is an
order-level id. All per-customer work is a hash aggregation on that key with
map-side partial aggregation, so a customer holding a large share of orders is
reduced to one partial row per map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.exprs import avg_round, avg_round_if, count_if, money, months_between_int, pct, ratio

CUSTOMER = "customer_unique_id"


def customer_summary(order_summary: DataFrame) -> DataFrame:
    """One row per customer with lifetime metrics and latest location."""
    os = order_summary
    valid = F.col("is_valid_delivery_record")
    # DISTINCT ON (customer) ... ORDER BY ts DESC, order_id DESC, folded into the same aggregation.
    latest = F.max_by(
        F.struct("customer_zip_code_prefix", "customer_city", "customer_state"),
        F.struct("order_purchase_timestamp", "order_id"),
    )
    cm = os.groupBy(CUSTOMER).agg(
        F.min("order_purchase_timestamp").alias("first_order_timestamp"),
        F.max("order_purchase_timestamp").alias("last_order_timestamp"),
        F.min("purchase_date").alias("first_order_date"),
        F.max("purchase_date").alias("last_order_date"),
        F.count(F.lit(1)).alias("order_count"),
        count_if(F.col("order_status") == "delivered").alias("delivered_order_count"),
        count_if(F.col("order_status") == "canceled").alias("canceled_order_count"),
        count_if(F.col("has_payment_record")).alias("paid_order_count"),
        count_if(F.col("has_review_record")).alias("reviewed_order_count"),
        count_if(valid).alias("valid_delivery_order_count"),
        count_if(valid & F.col("is_late_delivery")).alias("late_delivery_order_count"),
        F.sum("item_count").alias("total_item_count"),
        F.sum("item_price_total").alias("total_product_value"),
        F.sum("freight_total").alias("total_freight_value"),
        F.sum("gross_item_value").alias("total_gross_item_value"),
        F.sum("payment_value_total").alias("total_payment_value"),
        avg_round("payment_value_total").alias("average_order_payment"),
        avg_round("item_count").alias("average_items_per_order"),
        avg_round("average_review_score").alias("average_review_score"),
        avg_round_if(valid, "delivery_days").alias("average_delivery_days"),
        latest.alias("_loc"),
    )
    zero = F.lit(0)
    return cm.select(
        CUSTOMER,
        F.col("_loc.customer_zip_code_prefix").alias("latest_zip_code_prefix"),
        F.col("_loc.customer_city").alias("latest_customer_city"),
        F.col("_loc.customer_state").alias("latest_customer_state"),
        "first_order_timestamp",
        "last_order_timestamp",
        "first_order_date",
        "last_order_date",
        F.trunc("first_order_timestamp", "month").alias("first_order_month"),
        F.trunc("last_order_timestamp", "month").alias("last_order_month"),
        F.datediff("last_order_date", "first_order_date").alias("customer_relationship_days"),
        "order_count",
        "delivered_order_count",
        "canceled_order_count",
        "paid_order_count",
        "reviewed_order_count",
        "valid_delivery_order_count",
        "late_delivery_order_count",
        F.greatest(F.col("order_count") - 1, zero).alias("repeat_order_count"),
        (F.col("order_count") > 1).alias("is_repeat_customer"),
        F.coalesce("total_item_count", zero).alias("total_item_count"),
        money(F.coalesce("total_product_value", zero), 24).alias("total_product_value"),
        money(F.coalesce("total_freight_value", zero), 24).alias("total_freight_value"),
        money(F.coalesce("total_gross_item_value", zero), 24).alias("total_gross_item_value"),
        money(F.coalesce("total_payment_value", zero), 24).alias("total_payment_value"),
        "average_order_payment",
        "average_items_per_order",
        "average_review_score",
        "average_delivery_days",
        pct("late_delivery_order_count", "valid_delivery_order_count").alias("late_delivery_rate_pct"),
    )


def customer_monthly_activity(order_summary: DataFrame) -> DataFrame:
    """One row per customer and active month.

    The cohort month is the customer's first purchase month; it is taken with a
    window over the already-aggregated (customer, month) rows instead of a join
    back to V08, so the second shuffle moves at most one row per active month.
    """
    act = order_summary.groupBy(CUSTOMER, F.col("purchase_month").alias("activity_month")).agg(
        F.count(F.lit(1)).alias("monthly_order_count"),
        count_if(F.col("order_status") == "delivered").alias("monthly_delivered_order_count"),
        F.sum("item_count").alias("monthly_item_count"),
        money(F.coalesce(F.sum("payment_value_total"), F.lit(0)), 16).alias("monthly_payment_value"),
        avg_round("payment_value_total").alias("monthly_average_order_payment"),
    )
    act = act.withColumn("cohort_month", F.min("activity_month").over(Window.partitionBy(CUSTOMER)))
    return act.select(
        CUSTOMER,
        "cohort_month",
        "activity_month",
        months_between_int("activity_month", "cohort_month").alias("months_since_first_order"),
        (F.col("activity_month") == F.col("cohort_month")).alias("is_new_customer"),
        (F.col("activity_month") > F.col("cohort_month")).alias("is_returning_customer"),
        "monthly_order_count",
        "monthly_delivered_order_count",
        "monthly_item_count",
        "monthly_payment_value",
        "monthly_average_order_payment",
    )


def monthly_customer_metrics(activity: DataFrame) -> DataFrame:
    """One row per activity month."""
    return activity.groupBy("activity_month").agg(
        F.count(F.lit(1)).alias("active_customer_count"),
        count_if(F.col("is_new_customer")).alias("new_customer_count"),
        count_if(F.col("is_returning_customer")).alias("returning_customer_count"),
        count_if(F.col("monthly_order_count") > 1).alias("multi_order_customer_count"),
        F.sum("monthly_order_count").alias("order_count"),
        F.sum("monthly_delivered_order_count").alias("delivered_order_count"),
        F.sum("monthly_item_count").alias("item_count"),
        money(F.sum("monthly_payment_value"), 24).alias("payment_value"),
        ratio(F.sum("monthly_payment_value"), F.sum("monthly_order_count")).alias("average_payment_per_order"),
        ratio(F.sum("monthly_order_count"), F.count(F.lit(1))).alias("orders_per_active_customer"),
        pct(count_if(F.col("is_new_customer")), F.count(F.lit(1))).alias("new_customer_rate_pct"),
        pct(count_if(F.col("is_returning_customer")), F.count(F.lit(1))).alias("returning_customer_rate_pct"),
    )


def _month_calendar(bounds: DataFrame, first: str, last: str, out: str) -> DataFrame:
    """Gap-free month starts between two bounds of a one-row frame."""
    return bounds.select(F.explode(F.sequence(F.col(first), F.col(last), F.expr("INTERVAL 1 MONTH"))).alias(out))


def growth_pct(cur: str, prev: str) -> F.Column:
    """``ROUND(100 * (cur - prev) / NULLIF(prev, 0), 2)``; NULL when prev is NULL or 0."""
    return pct(F.col(cur) - F.col(prev), F.col(prev))


def monthly_customer_growth(metrics: DataFrame) -> DataFrame:
    """Gap-filled month series with previous values and growth rates.

    The calendar has one row per month of the observed span, so the ordered
    LAG window runs over tens of rows, not over the data.
    """
    bounds = metrics.agg(F.min("activity_month").alias("lo"), F.max("activity_month").alias("hi"))
    cal = _month_calendar(bounds, "lo", "hi", "activity_month")
    m = metrics.select("activity_month", "active_customer_count", "new_customer_count", "returning_customer_count", "order_count", "payment_value")
    s = cal.join(m, "activity_month", "left").select(
        "activity_month",
        F.coalesce("active_customer_count", F.lit(0)).alias("active_customer_count"),
        F.coalesce("new_customer_count", F.lit(0)).alias("new_customer_count"),
        F.coalesce("returning_customer_count", F.lit(0)).alias("returning_customer_count"),
        F.coalesce("order_count", F.lit(0)).alias("order_count"),
        money(F.coalesce("payment_value", F.lit(0)), 16).alias("payment_value"),
    )
    w = Window.orderBy("activity_month")
    s = s.withColumns(
        {
            "previous_active_customer_count": F.lag("active_customer_count").over(w),
            "previous_new_customer_count": F.lag("new_customer_count").over(w),
            "previous_payment_value": F.lag("payment_value").over(w),
        }
    )
    return s.withColumns(
        {
            "active_customer_growth_pct": growth_pct("active_customer_count", "previous_active_customer_count"),
            "new_customer_growth_pct": growth_pct("new_customer_count", "previous_new_customer_count"),
            "payment_growth_pct": growth_pct("payment_value", "previous_payment_value"),
        }
    )


# ------------------------------------------------------------------ cohorts
WORD_BITS = 64


def month_sets(order_summary: DataFrame, origin: str = "_origin") -> DataFrame:
    """One row per customer: the cohort month and the set of active months as a bitmap.

    Bit i of the bitmap (64-bit words, lowest first) is the i-th month from ``origin``, the earliest month of all, which
    stands in every row. The words are ORed by one hash aggregation with partial sums, so a customer is one row per
    map task whatever the number of orders, and no (customer, month) rows are made distinct.
    """
    span = order_summary.agg(F.min("purchase_month").alias("lo"), F.max("purchase_month").alias("hi")).first()
    months = 0 if span.lo is None else (span.hi.year - span.lo.year) * 12 + span.hi.month - span.lo.month + 1
    first = F.lit(span.lo).cast("date")
    at = months_between_int("purchase_month", first)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(WORD_BITS)))
    words = [F.coalesce(F.bit_or(F.when(F.floor(at / WORD_BITS) == w, bit)), F.lit(0).cast("long")) for w in range(-(-months // WORD_BITS) or 1)]
    return order_summary.groupBy(CUSTOMER).agg(F.min("purchase_month").alias("cohort_month"), F.array(*words).alias("months")).withColumn(origin, first)


def months_in(months: str, origin: str) -> F.Column:
    """The months of a bitmap, as an array of dates."""
    bits = F.transform(
        F.col(months),
        lambda word, w: F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda i: F.when(F.getbit(word, i) == 1, w * WORD_BITS + i)), lambda i: i.isNotNull()
        ),
    )
    return F.transform(F.flatten(bits), lambda i: F.add_months(F.col(origin), i))


def cohort_activity(sets: DataFrame, origin: str = "_origin") -> DataFrame:
    """``cohort_month, activity_month, active_customer_count``: customers with equal cohort and bitmap are counted first (there
    are few different bitmaps, as most customers are active in one month), then the set bits of each bitmap add its number."""
    patterns = sets.groupBy("cohort_month", "months", origin).agg(F.count(F.lit(1)).alias("n"))
    return patterns.select("cohort_month", F.explode(months_in("months", origin)).alias("activity_month"), "n").groupBy("cohort_month", "activity_month").agg(
        F.sum("n").alias("active_customer_count")
    )


def cohort_retention(sets: DataFrame, activity: DataFrame) -> DataFrame:
    """Dense cohort x month-offset grid from offset 0 to the latest activity month.

    Customers are counted from the bitmaps of ``month_sets``: a cohort's size is the number of its bitmaps, and a cell
    the number of those with the month's bit. Orders and payments are sums over ``activity``.
    """
    sizes = sets.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))
    counted = cohort_activity(sets)
    latest = counted.agg(F.max("activity_month").alias("_latest"))
    span = months_between_int("_latest", "cohort_month")
    # generate_series(0, n) is empty for n < 0; sequence(0, NULL) yields no rows (trap T5).
    grid = (
        sizes.crossJoin(F.broadcast(latest))
        .select(
            "cohort_month",
            "cohort_size",
            F.explode(F.sequence(F.lit(0), F.when(span >= 0, span))).alias("months_since_first_order"),
        )
        .withColumn("activity_month", F.add_months("cohort_month", F.col("months_since_first_order")))
    )
    sums = activity.groupBy("cohort_month", "activity_month").agg(
        F.sum("monthly_order_count").alias("order_count"),
        money(F.sum("monthly_payment_value"), 24).alias("payment_value"),
    )
    j = grid.join(counted, ["cohort_month", "activity_month"], "left").join(sums, ["cohort_month", "activity_month"], "left")
    active = F.coalesce("active_customer_count", F.lit(0))
    orders = F.coalesce("order_count", F.lit(0))
    pay = F.coalesce("payment_value", F.lit(0))
    return j.select(
        "cohort_month",
        "activity_month",
        "months_since_first_order",
        "cohort_size",
        active.alias("active_customer_count"),
        (F.col("cohort_size") - active).alias("inactive_customer_count"),
        orders.alias("order_count"),
        money(pay, 24).alias("payment_value"),
        pct(active, "cohort_size").alias("retention_rate_pct"),
        ratio(orders, "active_customer_count").alias("orders_per_active_customer"),
        ratio(pay, "active_customer_count").alias("payment_per_active_customer"),
    )


def cohort_matrix_12m(retention: DataFrame) -> DataFrame:
    """Wide month_0..month_12 retention per cohort; unobserved cells NULL."""
    wide = (
        retention.where(F.col("months_since_first_order") <= 12)
        .groupBy("cohort_month", "cohort_size")
        .pivot("months_since_first_order", list(range(13)))
        .agg(F.max("retention_rate_pct"))
    )
    return wide.select("cohort_month", "cohort_size", *[F.col(str(i)).alias(f"month_{i}") for i in range(13)])


def cohort_benchmark(retention: DataFrame) -> DataFrame:
    """Weighted and simple retention benchmarks per month offset (0..12)."""
    r = retention.where(F.col("months_since_first_order") <= 12)
    return r.groupBy("months_since_first_order").agg(
        F.count(F.lit(1)).alias("observed_cohort_count"),
        F.sum("cohort_size").alias("combined_cohort_size"),
        F.sum("active_customer_count").alias("active_customer_count"),
        pct(F.sum("active_customer_count"), F.sum("cohort_size")).alias("weighted_retention_rate_pct"),
        avg_round("retention_rate_pct").alias("average_cohort_retention_pct"),
        F.min("retention_rate_pct").alias("minimum_cohort_retention_pct"),
        F.max("retention_rate_pct").alias("maximum_cohort_retention_pct"),
    )


def customer_profile(customer_summary_df: DataFrame) -> DataFrame:
    """Q11: one row that profiles the customer summary."""
    return customer_summary_df.agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.count_distinct("customer_unique_id").alias("unique_customer_count"),
        F.sum("order_count").alias("reconstructed_order_count"),
        F.count_if("is_repeat_customer").alias("repeat_customer_count"),
        F.count_if(~F.col("is_repeat_customer")).alias("one_time_customer_count"),
    )


def monthly_profile(monthly: DataFrame) -> DataFrame:
    """Q11: one row that profiles the monthly customer metrics."""
    return monthly.agg(
        F.count(F.lit(1)).alias("month_count"),
        F.min("activity_month").alias("first_activity_month"),
        F.max("activity_month").alias("last_activity_month"),
        F.sum("new_customer_count").alias("reconstructed_customer_count"),
        F.sum("order_count").alias("reconstructed_order_count"),
    )


def recent_activity(monthly: DataFrame, k: int = 10) -> DataFrame:
    """O2: the last k active months, latest first."""
    columns = [
        "activity_month", "active_customer_count", "new_customer_count", "returning_customer_count", "order_count", "payment_value",
        "returning_customer_rate_pct",
    ]
    return monthly.select(*columns).orderBy(F.desc("activity_month")).limit(k)


def top_activity_months(growth: DataFrame, k: int = 5) -> DataFrame:
    """O2: the k months with the most active customers."""
    columns = [
        "activity_month", "active_customer_count", "new_customer_count", "returning_customer_count", "order_count", "payment_value",
        "active_customer_growth_pct",
    ]
    return growth.select(*columns).orderBy(F.desc("active_customer_count"), "activity_month").limit(k)


def cohort_drill_down(retention: DataFrame, cohort: str = "2017-01-01", k: int = 13) -> DataFrame:
    """O2: the first k months of one cohort."""
    columns = ["cohort_month", "activity_month", "months_since_first_order", "cohort_size", "active_customer_count", "retention_rate_pct"]
    return retention.where(F.col("cohort_month") == F.lit(cohort).cast("date")).select(*columns).orderBy("months_since_first_order").limit(k)
