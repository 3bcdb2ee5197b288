"""Parametrised queries as SQL table functions beside the fixed views.

``register_functions`` makes temporary SQL functions over the named views, so that a SQL user gives the cohort, the number
of rows or the span: ``SELECT * FROM cohort_drill_down(DATE'2017-01-01', 13)``. Their bodies are plain SQL, so filters of
the caller and of the function reach the same plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlens.plans.registry import register_views

#: Function -> (parameters, columns returned, views it reads, body).
FUNCTIONS: dict[str, tuple[str, str, list[str], str]] = {
    "cohort_drill_down": (
        "cohort DATE, months INT",
        "cohort_month DATE, activity_month DATE, months_since_first_order BIGINT, cohort_size BIGINT, active_customer_count BIGINT, retention_rate_pct DOUBLE",
        ["cohort_retention"],
        "SELECT cohort_month, activity_month, months_since_first_order, cohort_size, active_customer_count, retention_rate_pct FROM v_cohort_retention "
        "WHERE cohort_month = cohort_drill_down.cohort AND months_since_first_order < cohort_drill_down.months",
    ),
    "products_to_rank": (
        "k INT",
        "item_revenue_rank BIGINT, product_id STRING, item_price_total DOUBLE",
        ["product_performance"],
        "SELECT item_revenue_rank, product_id, item_price_total FROM v_product_performance WHERE item_revenue_rank <= products_to_rank.k",
    ),
    "month_calendar": (
        "first DATE, last DATE",
        "month DATE",
        [],
        "SELECT explode(CASE WHEN month_calendar.last >= month_calendar.first THEN sequence(trunc(month_calendar.first, 'MM'), trunc(month_calendar.last, 'MM'), INTERVAL 1 MONTH) END)",
    ),
    "sales_between": (
        "first DATE, last DATE",
        "month DATE, order_count BIGINT, payment_value_total DOUBLE",
        ["monthly_sales"],
        "SELECT c.month, coalesce(s.order_count, 0), coalesce(s.payment_value_total, 0) FROM month_calendar(sales_between.first, sales_between.last) AS c "
        "LEFT JOIN v_monthly_sales AS s ON s.sales_month = c.month",
    ),
}


def register_functions(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> list[str]:
    """Make the named functions (default: all) over the views they read, for this session."""
    wanted = list(FUNCTIONS) if names is None else names
    views = {v for n in wanted for v in FUNCTIONS[n][2]}
    if views:
        register_views(spark, sf_dir, sorted(views))
    if "sales_between" in wanted and "month_calendar" not in wanted:
        wanted = ["month_calendar", *wanted]
    for name in sorted(wanted, key=list(FUNCTIONS).index):
        parameters, columns, _, body = FUNCTIONS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    return wanted


def call(spark: SparkSession, sf_dir: str, name: str, *arguments: str) -> DataFrame:
    """A function's rows for arguments given as SQL literals."""
    register_functions(spark, sf_dir, [name])
    return spark.sql(f"SELECT * FROM {name}({', '.join(arguments)})")
