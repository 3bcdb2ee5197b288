"""RFM scoring and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.exprs import avg_round, count_if, money, pct, ratio
from marketlens.operators.quantiles import Tiles, with_tiles

CUSTOMER = "customer_unique_id"

# Fixed values that must equal the reference's: recency bands in days -> score.
RECENCY_BANDS = [(30, 5), (90, 4), (180, 3), (365, 2)]


def _completed(os: DataFrame) -> DataFrame:
    return os.where((F.col("order_status") == "delivered") & F.col("has_payment_record"))


def segment_expr(r: F.Column, f: F.Column, m: F.Column, completed: F.Column) -> F.Column:
    """Ten-way segment ladder; first match wins (branch order matters, SURVEY G8)."""
    return (
        F.when(completed == 0, "No Completed Purchase")
        .when((r >= 4) & (f >= 3) & (m >= 4), "Champions")
        .when((r >= 3) & (f >= 3), "Loyal Customers")
        .when((r >= 4) & (f == 2), "Potential Loyalists")
        .when((r == 5) & (f == 1), "New Customers")
        .when((r >= 4) & (f == 1), "Promising")
        .when((r <= 2) & (m >= 4), "High Value at Risk")
        .when((r <= 2) & (f >= 2), "At Risk")
        .when((r <= 2) & (f == 1), "Hibernating")
        .otherwise("Need Attention")
    )


def customer_rfm(order_summary: DataFrame, customer_summary_df: DataFrame) -> DataFrame:
    """Recency / frequency / monetary scores and segment for every customer."""
    done = _completed(order_summary)
    ref = done.agg(F.date_add(F.max("purchase_date"), 1).alias("analysis_reference_date"))
    metrics = done.groupBy(CUSTOMER).agg(
        F.min("purchase_date").alias("first_completed_order_date"),
        F.max("purchase_date").alias("last_completed_order_date"),
        F.count(F.lit(1)).alias("completed_order_count"),
        money(F.sum("payment_value_total"), 24).alias("completed_payment_value"),
        avg_round("payment_value_total").alias("average_completed_order_payment"),
    )
    # One-row reference date: a broadcast of a single row is bounded by construction.
    vals = metrics.crossJoin(F.broadcast(ref)).withColumn(
        "recency_days", F.datediff("analysis_reference_date", "last_completed_order_date")
    )
    rec = F.lit(1)
    for limit, score in reversed(RECENCY_BANDS):
        rec = F.when(F.col("recency_days") <= limit, F.lit(score)).otherwise(rec)
    vals = vals.withColumns(
        {"recency_score": rec, "frequency_score": F.least(F.col("completed_order_count"), F.lit(5)).cast("int")}
    )
    # NTILE(5) OVER (ORDER BY value, customer): borders from histograms, nothing is sorted.
    scored = with_tiles(vals, {"monetary_score": Tiles("completed_payment_value", CUSTOMER, 5)})

    cs = customer_summary_df.select(
        CUSTOMER,
        "latest_customer_state",
        F.col("order_count").alias("all_order_count"),
        F.col("total_payment_value").alias("all_order_payment_value"),
        "is_repeat_customer",
    )
    j = cs.join(scored, CUSTOMER, "left")
    zero = F.lit(0)
    out = j.select(
        CUSTOMER,
        "latest_customer_state",
        "all_order_count",
        "all_order_payment_value",
        "is_repeat_customer",
        "analysis_reference_date",
        "first_completed_order_date",
        "last_completed_order_date",
        "recency_days",
        F.coalesce("completed_order_count", zero).alias("completed_order_count"),
        money(F.coalesce("completed_payment_value", zero), 24).alias("monetary_value"),
        "average_completed_order_payment",
        F.coalesce("recency_score", zero).alias("recency_score"),
        F.coalesce("frequency_score", zero).alias("frequency_score"),
        F.coalesce("monetary_score", zero).alias("monetary_score"),
    )
    r, f, m = F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")
    out = out.withColumns(
        {"rfm_total_score": r + f + m, "rfm_code": F.concat_ws("", r.cast("string"), f.cast("string"), m.cast("string"))}
    )
    return out.withColumn("customer_segment", segment_expr(r, f, m, F.col("completed_order_count")))


def segment_summary(rfm: DataFrame) -> DataFrame:
    """One row per segment; the share uses the total over <= 10 segment rows."""
    g = rfm.groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum("completed_order_count").alias("completed_order_count"),
        money(F.sum("monetary_value"), 24).alias("monetary_value"),
        avg_round("recency_days").alias("average_recency_days"),
        avg_round("completed_order_count").alias("average_completed_orders"),
        avg_round("monetary_value").alias("average_customer_value"),
    )
    total = F.sum("customer_count").over(Window.partitionBy())
    return g.select(
        "customer_segment",
        "customer_count",
        pct("customer_count", total).alias("customer_share_pct"),
        "completed_order_count",
        "monetary_value",
        "average_recency_days",
        "average_completed_orders",
        "average_customer_value",
    )


def customer_kpis(rfm: DataFrame) -> DataFrame:
    """One row of customer KPIs (two repeat-rate definitions)."""
    n = F.count(F.lit(1))
    buyers = count_if(F.col("completed_order_count") > 0)
    repeat_done = count_if(F.col("completed_order_count") > 1)
    return rfm.agg(
        n.alias("total_customer_count"),
        count_if(F.col("is_repeat_customer")).alias("all_order_repeat_customer_count"),
        pct(count_if(F.col("is_repeat_customer")), n).alias("all_order_repeat_customer_rate_pct"),
        buyers.alias("completed_purchase_customer_count"),
        count_if(F.col("completed_order_count") == 0).alias("no_completed_purchase_customer_count"),
        repeat_done.alias("completed_repeat_customer_count"),
        pct(repeat_done, buyers).alias("completed_repeat_customer_rate_pct"),
        F.sum("completed_order_count").alias("completed_order_count"),
        money(F.sum("monetary_value"), 24).alias("completed_payment_value"),
        ratio(F.sum("monetary_value"), F.sum("completed_order_count")).alias("average_completed_order_value"),
        ratio(F.sum("monetary_value"), buyers).alias("average_completed_customer_value"),
        ratio(F.sum("completed_order_count"), buyers).alias("average_completed_orders_per_customer"),
        F.max("analysis_reference_date").alias("analysis_reference_date"),
    )
