"""DuckDB SQL of the order and item models for ``oracle_sql()``, written from the rules in SURVEY 2.1.

The child rows of an order (items, payments, reviews) are stacked into one narrow relation, ``f_parts``,
which is grouped by order once; every per-order number is a filtered aggregate of it. The Spark side
aggregates three tables and joins them, so the two derivations share no step.
"""

from __future__ import annotations

from marketlens.functions.sqltext import avg, rdiv

#: The parts of an order: a letter, its table, and what each part gives (name, two numbers, two times, text).
_PARTS = {
    "i": ("cl_order_items", "product_id AS a, seller_id AS b, price AS x, freight_value AS y, NULL AS n, NULL AS t1, NULL AS t2, NULL AS txt"),
    "p": ("cl_payments", "payment_type, NULL, payment_value, NULL, payment_installments, NULL, NULL, NULL"),
    "r": ("cl_reviews", "NULL, NULL, NULL, NULL, review_score, review_creation_date, review_answer_timestamp, review_comment_message"),
}


def _of(kind: str, aggregate: str, also: str = "") -> str:
    return f"{aggregate} FILTER (WHERE kind = '{kind}'{also})"


#: Per-order results by part, in the order of the output: name, SQL over f_parts.
ORDER_PARTS: dict[str, dict[str, str]] = {
    "i": {
        "item_count": _of("i", "count(*)"),
        "distinct_product_count": _of("i", "count(DISTINCT a)"),
        "seller_count": _of("i", "count(DISTINCT b)"),
        "item_price_total": _of("i", "sum(x)"),
        "freight_total": _of("i", "sum(y)"),
        "gross_item_value": _of("i", "sum(x + y)"),
    },
    "p": {
        "payment_record_count": _of("p", "count(*)"),
        "payment_type_count": _of("p", "count(DISTINCT a)"),
        "payment_value_total": _of("p", "sum(x)"),
        "maximum_installments": _of("p", "max(n)"),
        "payment_types": _of("p", "string_agg(DISTINCT a, ', ' ORDER BY a)"),
        "uses_credit_card": _of("p", "bool_or(a = 'credit_card')"),
        "uses_voucher": _of("p", "bool_or(a = 'voucher')"),
    },
    "r": {
        "review_record_count": _of("r", "count(*)"),
        "average_review_score": avg("n", where="kind = 'r'"),
        "minimum_review_score": _of("r", "min(n)"),
        "maximum_review_score": _of("r", "max(n)"),
        "first_review_date": _of("r", "min(t1)"),
        "latest_review_answer": _of("r", "max(t2)"),
        "has_written_comment": _of("r", "bool_or(trim(coalesce(txt, '')) <> '')"),
    },
}
#: Counts that are zero, not NULL, for an order without such parts.
_ZERO = ("item_count", "distinct_product_count", "seller_count", "payment_record_count", "payment_type_count", "review_record_count")
_HAS = {"i": "has_item_record", "p": "has_payment_record", "r": "has_review_record"}
_AGGREGATES = {"i": "v_order_items_agg", "p": "v_payments_agg", "r": "v_reviews_agg"}

PLACED, CARRIER, ARRIVED, DUE = "order_purchase_timestamp", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"


def days(later: str, earlier: str) -> str:
    """Calendar days between two times; NULL if either is."""
    return f"date_diff('day', {earlier}, {later})"


def month_start(ts: str) -> str:
    return f"make_date(year({ts}), month({ts}), 1)"


#: What both models take from an order's times.
DELIVERY = {
    "delivery_days": days(ARRIVED, PLACED),
    "delivery_delay_days": days(ARRIVED, DUE),
    "is_late_delivery": f"{days(ARRIVED, DUE)} > 0",
}
QUALITY = ["has_timestamp_anomaly", "has_status_date_mismatch", "is_valid_delivery_record"]


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


def model_ctes() -> str:
    stacked = " UNION ALL ".join(f"SELECT order_id, '{k}' AS kind, {cols} FROM {table}" for k, (table, cols) in _PARTS.items())
    per_order = ", ".join(_list(c) for c in ORDER_PARTS.values())
    has = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') > 0 AS {n}" for k, n in _HAS.items())
    parts = [n for c in ORDER_PARTS.values() for n in c]
    taken = ", ".join(f"coalesce({n}, 0) AS {n}" if n in _ZERO else n for n in parts)
    flags = ", ".join(f"coalesce({n}, FALSE) AS {n}" for n in _HAS.values())
    views = ",\n".join(f"{_AGGREGATES[k]} AS (SELECT order_id, {', '.join(c)} FROM f_order_parts WHERE {_HAS[k]})" for k, c in ORDER_PARTS.items())
    return f"""
f_parts AS ({stacked}),
f_order_parts AS (SELECT order_id, {per_order}, {has} FROM f_parts GROUP BY order_id),
{views},
f_who AS (SELECT customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state FROM cl_customers),
f_orders AS (
  SELECT *, CAST({PLACED} AS DATE) AS purchase_date, {month_start(PLACED)} AS purchase_month, year({PLACED}) AS purchase_year,
    {_list(DELIVERY)}
  FROM cl_orders LEFT JOIN f_who USING (customer_id)
),
v_order_summary AS (
  SELECT f_orders.*, quarter({PLACED}) AS purchase_quarter,
    {rdiv(f"epoch_us(order_approved_at) - epoch_us({PLACED})", "3600000000", 2)} AS approval_hours,
    {days(CARRIER, PLACED)} AS carrier_handling_days, {days(DUE, PLACED)} AS estimated_delivery_days,
    order_status = 'canceled' AS is_canceled, {ARRIVED} IS NOT NULL AS is_delivered,
    {taken}, payment_value_total - gross_item_value AS payment_difference, {flags}
  FROM f_orders LEFT JOIN f_order_parts USING (order_id)
),
v_order_item_detail AS (
  SELECT *, price + freight_value AS gross_item_value, {CARRIER} > shipping_limit_date AS shipped_after_shipping_limit
  FROM cl_order_items LEFT JOIN f_orders USING (order_id)
    LEFT JOIN (SELECT product_id, product_category_name, product_category_name_english FROM cl_products) USING (product_id)
    LEFT JOIN cl_sellers USING (seller_id)
)"""
