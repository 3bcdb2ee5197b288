"""``oracle_sql()`` texts: DuckDB SQL over the driver's parquet views.

Each text is one ``WITH ... SELECT``: adapter and cleaning CTEs
(:mod:`sqlbase`), the models (:mod:`sqlmodel`), the report CTEs
(:mod:`sqlviews`) and a final projection that turns exact DECIMAL results into
DOUBLE, like ``finish``.
"""

from __future__ import annotations

import re

from marketlens.plans import sqlbase, sqlmodel, sqlquality, sqlviews
from marketlens.plans.catalog import TEST_MANUAL_TRANSLATIONS
from marketlens.plans.output_types import OUTPUT_TYPES
from marketlens.sources.testdata import HIGH_VALUE_RANK

# Spark result type -> DuckDB type of the oracle's final projection.
DUCK_TYPES = {
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}

BODIES: dict[str, str] = {
    "order_items_agg": "SELECT * FROM v_order_items_agg",
    "payments_agg": "SELECT * FROM v_payments_agg",
    "reviews_agg": "SELECT * FROM v_reviews_agg",
    "order_summary": "SELECT * FROM v_order_summary",
    "order_item_detail": "SELECT * FROM v_order_item_detail",
    "customer_summary": "SELECT * FROM v_customer_summary",
    "customer_monthly_activity": "SELECT * FROM v_customer_monthly_activity",
    "monthly_customer_metrics": "SELECT * FROM v_monthly_customer_metrics",
    "cohort_retention": "SELECT * FROM v_customer_cohort_retention",
    "cohort_matrix_12m": "SELECT * FROM v_cohort_retention_matrix_12m",
    "cohort_benchmark": "SELECT * FROM v_cohort_retention_benchmark",
    "customer_rfm": "SELECT * FROM c_rfm_coded",
    "segment_summary": "SELECT * FROM v_customer_segment_summary",
    "customer_kpis": "SELECT * FROM v_customer_kpi_summary",
    "monthly_customer_growth": "SELECT * FROM v_monthly_customer_growth",
    "monthly_sales": "SELECT * FROM v_monthly_sales",
    "category_performance": "SELECT * FROM v_category_performance",
    "product_performance": "SELECT * FROM v_product_performance",
    "sales_kpis": "SELECT * FROM v_sales_kpis",
    "revenue_concentration": "SELECT * FROM v_product_revenue_concentration",
    "sales_validation": "SELECT * FROM v_sales_validation",
    "seller_order_performance": "SELECT * FROM v_seller_order_performance",
    "seller_performance": "SELECT * FROM v_seller_performance",
    "monthly_delivery": "SELECT * FROM v_monthly_delivery_performance",
    "state_delivery": "SELECT * FROM v_state_delivery_performance",
    "operations_kpis": "SELECT * FROM v_operations_kpis",
    "delivery_review_impact": "SELECT * FROM v_delivery_review_impact",
    "seller_risk": "SELECT * FROM v_seller_risk",
    "operations_validation": "SELECT * FROM v_operations_validation",
    "priority_sellers": "SELECT * FROM v_seller_risk WHERE seller_risk_segment <> 'Stable'",
    "top_products": "SELECT * FROM v_product_performance ORDER BY item_price_total DESC, product_id LIMIT 20",
    "risk_segment_summary": (
        "SELECT seller_risk_segment, COUNT(*) AS seller_count, COUNT(*) FILTER (WHERE is_high_value_seller) AS high_value_seller_count, "
        + sqlviews.avg("late_delivery_rate_pct", scale=2) + " AS average_late_delivery_rate_pct, "
        + sqlviews.avg("low_review_rate_pct", scale=2) + " AS average_low_review_rate_pct, "
        + "ROUND(SUM(item_price_total), 2) AS item_price_total FROM v_seller_risk GROUP BY seller_risk_segment"
    ),
    "monthly_order_performance": (
        "SELECT purchase_month, COUNT(*) AS order_count, COUNT(DISTINCT customer_unique_id) AS customer_count, "
        "SUM(payment_value_total) AS total_payment_value FROM v_order_summary GROUP BY purchase_month"
    ),
    "category_items_all": (
        "SELECT product_category_name_english, COUNT(*) AS item_count, SUM(price) AS product_revenue, "
        "SUM(freight_value) AS freight_value FROM v_order_item_detail GROUP BY product_category_name_english"
    ),
    "late_rate": (
        "SELECT " + sqlviews.pct("COUNT(*) FILTER (WHERE is_late_delivery)", "COUNT(*)")
        + " AS late_delivery_rate_pct FROM v_order_summary WHERE is_valid_delivery_record"
    ),
}
BODIES.update(
    {
        "database_validation": "SELECT * FROM v_database_validation",
        "model_validation": "SELECT * FROM v_analytics_model_validation",
        "customer_validation": "SELECT * FROM v_customer_analytics_validation",
    }
)
def _list(source: str, order: str, limit: int = 0, where: str = "") -> str:
    return f"SELECT * FROM {source}{f' WHERE {where}' if where else ''} ORDER BY {order}{f' LIMIT {limit}' if limit else ''}"


BODIES.update(
    {
        "preview_products": _list("v_product_performance", "item_price_total DESC, product_id", 10),
        "top_sellers": _list("v_seller_performance", "item_price_total DESC, seller_id", 10),
        "recent_delivery": _list("v_monthly_delivery_performance", "purchase_month DESC", 12),
        "states_by_late_rate": _list("v_state_delivery_performance", "late_delivery_rate_pct DESC", where="completed_order_count >= 100"),
        "recent_activity": _list("v_monthly_customer_metrics", "activity_month DESC", 10),
        "top_activity_months": _list("v_monthly_customer_growth", "active_customer_count DESC, activity_month", 5),
        "cohort_drill_down": _list("v_customer_cohort_retention", "age", 13, "cohort_month = DATE '2017-01-01'"),
        "refreshed_order_summary": "SELECT * FROM v_order_summary",
        "refreshed_item_detail": "SELECT * FROM v_order_item_detail",
        "function_cohort_drill_down": (
            "SELECT cohort_month, activity_month, age AS months_since_first_order, cohort_size, active_customer_count, retention_rate_pct "
            "FROM (SELECT *, months_since_first_order AS age FROM v_customer_cohort_retention) WHERE cohort_month = DATE '2017-01-01' AND age < 13"
        ),
        "function_products_to_rank": "SELECT item_revenue_rank, product_id, item_price_total FROM v_product_performance WHERE item_revenue_rank <= 25",
        "function_sales_between": (
            "SELECT CAST(c.month AS DATE) AS month, coalesce(s.order_count, 0) AS order_count, coalesce(s.payment_value_total, 0) AS payment_value_total "
            "FROM (SELECT unnest(generate_series(DATE '2017-03-01', DATE '2018-02-01', INTERVAL 1 MONTH)) AS month) AS c LEFT JOIN v_monthly_sales AS s ON s.sales_month = c.month"
        ),
        "customer_profile": (
            "SELECT count(*) AS customer_count, count(DISTINCT customer_unique_id) AS unique_customer_count, sum(order_count) AS reconstructed_order_count, "
            "count(*) FILTER (WHERE order_count > 1) AS repeat_customer_count, count(*) FILTER (WHERE order_count = 1) AS one_time_customer_count FROM v_customer_summary"
        ),
        "monthly_profile": (
            "SELECT count(*) AS month_count, min(activity_month) AS first_activity_month, max(activity_month) AS last_activity_month, "
            "sum(new_customer_count) AS reconstructed_customer_count, sum(order_count) AS reconstructed_order_count FROM v_monthly_customer_metrics"
        ),
        "database_check_totals": "SELECT status, count(*) AS check_count FROM v_database_validation GROUP BY status",
    }
)
BODIES.update(sqlquality.bodies(len(TEST_MANUAL_TRANSLATIONS)))


def _ctes() -> list[tuple[str, str]]:
    """All CTEs in dependency order as (name, text)."""
    chunks = [
        sqlbase.RAW,
        sqlbase.clean_ctes(TEST_MANUAL_TRANSLATIONS),
        sqlmodel.model_ctes(),
        *sqlviews.view_ctes(HIGH_VALUE_RANK, len(TEST_MANUAL_TRANSLATIONS)),
        sqlquality.STD,
    ]
    out = []
    for chunk in chunks:
        for part in _split_top_level(chunk):
            m = re.match(r"\s*(\w+)\s+AS\s*\(", part)
            if m:
                out.append((m.group(1), part.strip()))
    return out


def _split_top_level(text: str) -> list[str]:
    """Split a CTE list on commas outside parentheses and quotes."""
    parts, depth, quote, cur = [], 0, False, []
    for ch in text:
        if ch == "'":
            quote = not quote
        elif not quote and ch == "(":
            depth += 1
        elif not quote and ch == ")":
            depth -= 1
        if ch == "," and depth == 0 and not quote:
            parts.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
    parts.append("".join(cur))
    return [p for p in parts if p.strip()]


def _needed(ctes: list[tuple[str, str]], body: str) -> str:
    """WITH clause holding only the CTEs the body needs (transitively)."""
    names = [n for n, _ in ctes]
    text = dict(ctes)
    need: set[str] = set()
    frontier = [body]
    while frontier:
        t = frontier.pop()
        for n in names:
            if n not in need and re.search(rf"\b{n}\b", t):
                need.add(n)
                frontier.append(text[n])
    return "WITH " + ",\n".join(text[n] for n in names if n in need)


def oracle_queries() -> dict[str, str]:
    ctes = _ctes()
    out = {}
    for name, body in BODIES.items():
        cols = ", ".join(f"CAST(q.{c} AS {DUCK_TYPES[t]}) AS {c}" for c, t in OUTPUT_TYPES[name])
        out[name] = f"{_needed(ctes, body)}\nSELECT {cols} FROM (\n{body}\n) AS q"
    return out
