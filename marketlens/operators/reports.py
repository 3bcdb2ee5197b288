"""Report-preparation frames behind the reference's charts.

Drawing is not built; these are the data frames the charts consume. All
inputs are aggregates (one row per month, cohort, state or segment), so the
ordered windows below run over tens of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.exprs import pct, ratio

TREND_START = "2017-01-01"
# Fixed values that must equal the reference's.
HEATMAP_QUANTILE = 0.95
HEATMAP_MIN, HEATMAP_MAX = 5.0, 20.0
BUBBLE_BASE, BUBBLE_SCALE = 80.0, 900.0
DELIVERY_STATUS_ORDER = ["On Time or Early", "Late"]
RISK_SEGMENT_ORDER = ["Stable", "Monitor", "High Risk", "High-Value At Risk"]


def peak_month(monthly_sales_df: DataFrame) -> DataFrame:
    """Months from 2017 on with the highest payment value and order count."""
    d = monthly_sales_df.where(F.col("sales_month") >= F.lit(TREND_START).cast("date"))
    one = d.agg(
        # idxmax: first (earliest) month among ties
        F.max_by("sales_month", F.struct(F.col("payment_value_total"), -F.datediff("sales_month", F.lit(TREND_START)))).alias("peak_sales_month"),
        F.max("payment_value_total").alias("peak_payment_value"),
        F.max_by("sales_month", F.struct(F.col("order_count"), -F.datediff("sales_month", F.lit(TREND_START)))).alias("peak_orders_month"),
        F.max("order_count").alias("peak_order_count"),
    )
    return one


def growth_sign(growth: DataFrame) -> DataFrame:
    """R2: customer growth from 2017, first displayed month skipped, sign class per month."""
    d = growth.where(F.col("activity_month") >= F.lit(TREND_START).cast("date"))
    first = d.agg(F.min("activity_month").alias("_first"))
    d = d.crossJoin(F.broadcast(first)).where(F.col("activity_month") > F.col("_first"))
    g = F.col("active_customer_growth_pct")
    return d.select(
        "activity_month",
        "active_customer_count",
        g.alias("active_customer_growth_pct"),
        F.when(g >= 0, "growth").otherwise("decline").alias("growth_direction"),
    )


def retention_heatmap_frame(matrix: DataFrame) -> DataFrame:
    """Long cohort x month (M1..M12) retention with label and colour cap.

    The cap is the 0.95 quantile of all shown values, clamped to [5, 20].
    """
    cols = [f"month_{i}" for i in range(1, 13)]
    long = matrix.select(
        "cohort_month",
        "cohort_size",
        F.explode(F.array(*[F.struct(F.lit(f"M{i}").alias("month_label"), F.lit(i).alias("month_offset"), F.col(c).cast("double").alias("retention_pct")) for i, c in enumerate(cols, 1)])).alias("r"),
    ).select("cohort_month", "cohort_size", "r.*")
    # values may come as shares: all at most 1 are taken times 100, month 0 included in the test as it always is 100 %
    scale = matrix.agg(F.max(F.greatest(*[F.col(f"month_{i}").cast("double") for i in range(13)])).alias("_top"))
    scale = scale.select(F.when(F.col("_top") <= 1, F.lit(100.0)).otherwise(F.lit(1.0)).alias("_scale"))
    long = long.crossJoin(F.broadcast(scale)).withColumn("retention_pct", F.col("retention_pct") * F.col("_scale")).drop("_scale")  # one row
    cap = long.agg(F.percentile(F.col("retention_pct"), HEATMAP_QUANTILE).alias("_q"))
    cap = cap.select(F.least(F.greatest(F.col("_q"), F.lit(HEATMAP_MIN)), F.lit(HEATMAP_MAX)).alias("heatmap_max"))
    label = F.concat(F.date_format("cohort_month", "yyyy-MM"), F.lit(" (n="), F.format_number(F.col("cohort_size"), 0), F.lit(")"))
    return long.crossJoin(F.broadcast(cap)).select(
        label.alias("cohort_label"), "cohort_month", "month_label", "month_offset", "retention_pct", "heatmap_max"
    )


def segment_distribution(segments: DataFrame) -> DataFrame:
    """Segments ordered by customer count."""
    return segments.select("customer_segment", "customer_count", "customer_share_pct").orderBy(F.desc("customer_count"), "customer_segment")


def top_categories_frame(categories: DataFrame, k: int = 10) -> DataFrame:
    """Top-k categories by revenue, smallest first for display (O6), plus the overall freight share of all categories."""
    overall = categories.agg(pct(F.sum("freight_total"), F.sum(F.col("item_price_total") + F.col("freight_total"))).alias("overall_freight_share_pct"))
    top = categories.orderBy(F.desc("item_price_total"), "product_category_name_english").limit(k)
    label = F.initcap(F.regexp_replace("product_category_name_english", "_", " "))
    return top.crossJoin(F.broadcast(overall)).select(
        "product_category_name_english", label.alias("category_label"), "item_price_total", "freight_share_pct", "overall_freight_share_pct"
    ).orderBy("item_price_total", F.desc("product_category_name_english"))


def _order_by_list(col: str, values: list[str]) -> F.Column:
    e = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        e = F.when(F.col(col) == v, F.lit(i)).otherwise(e)
    return e


def delivery_comparison(impact: DataFrame) -> DataFrame:
    """Delivery status rows in fixed display order."""
    return impact.withColumn("display_order", _order_by_list("delivery_status", DELIVERY_STATUS_ORDER))


def state_scatter_frame(states: DataFrame, kpis: DataFrame) -> DataFrame:
    """States with complete metrics, overall benchmarks and sqrt-scaled bubble size."""
    s = states.dropna(subset=["average_delivery_days", "late_delivery_rate_pct", "average_review_score"])
    mx = s.agg(F.max("completed_order_count").alias("_max"))
    k = kpis.select(
        F.col("average_delivery_days").cast("double").alias("overall_delivery_days"),
        F.col("late_delivery_rate_pct").cast("double").alias("overall_late_rate"),
    )
    return s.crossJoin(F.broadcast(mx)).crossJoin(F.broadcast(k)).select(
        "customer_state",
        "completed_order_count",
        F.col("average_delivery_days").cast("double").alias("average_delivery_days"),
        F.col("late_delivery_rate_pct").cast("double").alias("late_delivery_rate_pct"),
        F.col("average_review_score").cast("double").alias("average_review_score"),
        "overall_delivery_days",
        "overall_late_rate",
        (F.lit(BUBBLE_BASE) + F.lit(BUBBLE_SCALE) * F.sqrt(F.col("completed_order_count") / F.col("_max"))).alias("bubble_size"),
    )


def risk_summary_frame(risk: DataFrame) -> DataFrame:
    """Per risk segment sellers, high-value sellers, revenue and mean rates, display order."""
    hv = F.lower(F.col("is_high_value_seller").cast("string")).isin("true", "t", "1")
    g = risk.groupBy("seller_risk_segment").agg(
        F.count(F.lit(1)).alias("seller_count"),
        F.count_if(hv).alias("high_value_seller_count"),
        F.sum("item_price_total").alias("item_price_total"),
        ratio(F.sum("late_delivery_rate_pct"), F.count("late_delivery_rate_pct"), 6).alias("mean_late_delivery_rate_pct"),
        ratio(F.sum("low_review_rate_pct"), F.count("low_review_rate_pct"), 6).alias("mean_low_review_rate_pct"),
    )
    return g.withColumn("display_order", _order_by_list("seller_risk_segment", RISK_SEGMENT_ORDER))
