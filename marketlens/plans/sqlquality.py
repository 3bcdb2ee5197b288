"""DuckDB twins of the cleaning reports, quality profiles and report frames.

Generated from the same rule constants the Spark operators use, so the two
sides cannot drift apart.
"""

from __future__ import annotations

import re

from marketlens.functions.sqltext import avg, pct, rdiv
from marketlens.operators.cleaning import DATE_COLUMNS, TIMESTAMP_RULES, STATUS_RULES, ZIP_COLUMNS
from marketlens.operators.quality import (
    BUSINESS_RULES,
    CANDIDATE_KEYS,
    CONSTRAINTS,
    FINAL_KEYS,
    FOREIGN_KEYS,
    NUMERIC_COLUMNS,
    TREATMENTS,
)
from marketlens.operators.reports import (
    BUBBLE_BASE,
    BUBBLE_SCALE,
    DELIVERY_STATUS_ORDER,
    HEATMAP_MAX,
    HEATMAP_MIN,
    HEATMAP_QUANTILE,
    RISK_SEGMENT_ORDER,
    TREND_START,
)
from marketlens.plans.sqlbase import _strip, _ts, _whole, _zip
from marketlens.sources.schemas import CLEAN_COLUMNS, RAW_COLUMNS

U = "\nUNION ALL\n"


def clean_dates() -> str:
    parts = []
    for t, cols in DATE_COLUMNS.items():
        for c in cols:
            parts.append(
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_before, "
                f"COUNT(*) FILTER (WHERE {_ts(c)} IS NULL) AS missing_after, "
                f"COUNT(*) FILTER (WHERE {c} IS NOT NULL AND {_ts(c)} IS NULL) AS parse_failures, "
                f"MIN({_ts(c)}) AS minimum_date, MAX({_ts(c)}) AS maximum_date FROM raw_{t}"
            )
    return U.join(parts)


def clean_zip() -> str:
    parts = []
    for t, c in ZIP_COLUMNS.items():
        z = _zip(c)
        parts.append(
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) FILTER (WHERE {z} IS NULL) AS missing_values, "
            f"COUNT(*) FILTER (WHERE {c} IS NOT NULL AND {_whole(c)} IS NULL) AS invalid_parse_values, "
            f"COUNT(*) FILTER (WHERE {z} IS NOT NULL AND length({z}) <> 5) AS invalid_length_values FROM raw_{t}"
        )
    return U.join(parts)


def _text_columns(t: str) -> list[tuple[str, str]]:
    out = []
    for c, typ in RAW_COLUMNS[t]:
        if c == ZIP_COLUMNS.get(t):
            out.append((c, _zip(c)))
        elif typ == "string" and c not in DATE_COLUMNS.get(t, []):
            out.append((c, c))
    return out


def clean_text() -> str:
    parts = []
    for t in RAW_COLUMNS:
        for c, e in _text_columns(t):
            blank = f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g') = ''"
            parts.append(
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) FILTER (WHERE {e} IS NULL) AS missing_before, "
                f"COUNT(*) FILTER (WHERE {blank}) AS blank_strings_removed, "
                f"COUNT(*) FILTER (WHERE {e} IS NULL) + COUNT(*) FILTER (WHERE {blank}) AS missing_after, 'string' AS data_type_after FROM raw_{t}"
            )
    return U.join(parts)


STD = f"""
std_products AS (SELECT {_strip('product_id')} AS product_id, {_strip('product_category_name')} AS product_category_name FROM raw_products),
std_translation AS (
  SELECT {_strip('product_category_name')} AS product_category_name,
    {_strip('product_category_name_english')} AS product_category_name_english FROM raw_category_translation
)"""


def clean_categories(manual_rows: int) -> str:
    metrics = [
        ("missing_categories_before", "SELECT COUNT(*) FROM std_products WHERE product_category_name IS NULL"),
        (
            "untranslated_products_before",
            "SELECT COUNT(*) FROM std_products p WHERE p.product_category_name IS NOT NULL AND NOT EXISTS "
            "(SELECT 1 FROM std_translation t WHERE t.product_category_name = p.product_category_name)",
        ),
        ("translation_rows_before", "SELECT COUNT(*) FROM std_translation"),
        ("translation_rows_after", f"SELECT COUNT(*) + {manual_rows} FROM std_translation"),
        ("product_rows_before_merge", "SELECT COUNT(*) FROM std_products"),
        ("product_rows_after_merge", "SELECT COUNT(*) FROM cl_products"),
        ("unmatched_products_after_merge", "SELECT COUNT(*) FROM cl_products WHERE product_category_name_english IS NULL"),
        ("missing_english_categories_after", "SELECT COUNT(*) FROM cl_products WHERE product_category_name_english IS NULL"),
    ]
    return U.join(f"SELECT '{m}' AS metric, CAST(({q}) AS BIGINT) AS value" for m, q in metrics)


UNTRANSLATED = (
    "SELECT p.product_category_name, COUNT(*) AS product_rows FROM std_products p WHERE p.product_category_name IS NOT NULL "
    "AND NOT EXISTS (SELECT 1 FROM std_translation t WHERE t.product_category_name = p.product_category_name) "
    "GROUP BY p.product_category_name"
)


def clean_geolocation() -> str:
    outside = "NOT coalesce(abs(geolocation_lat) <= 90 AND abs(geolocation_lng) <= 180, FALSE)"
    metrics = [
        ("raw_rows", "SELECT COUNT(*) FROM raw_geolocation"),
        ("exact_duplicate_rows", "SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw_geolocation)) FROM raw_geolocation"),
        ("invalid_coordinate_rows", f"SELECT COUNT(*) FROM raw_geolocation WHERE {outside}"),
        ("unique_zip_codes_before", "SELECT COUNT(DISTINCT geolocation_zip_code_prefix) FROM raw_geolocation"),
        ("clean_rows", "SELECT COUNT(*) FROM cl_geolocation"),
        ("duplicate_zip_codes_after", "SELECT COUNT(*) - COUNT(DISTINCT geolocation_zip_code_prefix) FROM cl_geolocation"),
    ]
    return U.join(f"SELECT '{m}' AS metric, CAST(({q}) AS BIGINT) AS value" for m, q in metrics)


def zip_coverage() -> str:
    parts = []
    for t, c in (("customers", "customer_zip_code_prefix"), ("sellers", "seller_zip_code_prefix")):
        known = f"{c} IN (SELECT geolocation_zip_code_prefix FROM cl_geolocation)"
        missed = f"COUNT(*) FILTER (WHERE NOT {known})"
        parts.append(
            f"SELECT '{t}' AS table_name, '{c}' AS zip_column, COUNT(*) AS total_rows, {missed} AS unmatched_rows, "
            f"COUNT(DISTINCT {c}) FILTER (WHERE NOT {known}) AS unmatched_unique_zip_codes, "
            f"{pct(f'COUNT({c}) - {missed}', f'COUNT({c})')} AS coverage_pct FROM cl_{t}"
        )
    return U.join(parts)


def order_timestamp_checks() -> str:
    return U.join(
        f"SELECT '{r}' AS check_name, COUNT(*) FILTER (WHERE r_{r}) AS affected_rows FROM cl_order_rules"
        for r in TIMESTAMP_RULES + STATUS_RULES
    )


STATUS = (
    "SELECT order_status, COUNT(*) AS order_count, "
    + pct("COUNT(*)", "(SELECT COUNT(*) FROM cl_orders)")
    + " AS order_pct FROM cl_orders GROUP BY order_status"
)


def numeric_profile() -> str:
    return U.join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_values, "
        f"COUNT(*) FILTER (WHERE {c} < 0) AS negative_values, COUNT(*) FILTER (WHERE {c} = 0) AS zero_values, "
        f"MIN(CAST({c} AS DOUBLE)) AS minimum_value, MAX(CAST({c} AS DOUBLE)) AS maximum_value FROM raw_{t}"
        for t, c in NUMERIC_COLUMNS
    )


def business_rules() -> str:
    return U.join(f"SELECT '{n}' AS check_name, COUNT(*) FILTER (WHERE {cond}) AS affected_rows FROM raw_{t}" for n, t, cond in BUSINESS_RULES)


def _duck(cond: str) -> str:
    return re.sub(r"(\w+) RLIKE ('[^']*')", r"regexp_matches(\1, \2)", cond)


def constraint_checks() -> str:
    return U.join(
        f"SELECT '{t}' AS table_name, '{n}' AS rule_name, COUNT(*) FILTER (WHERE {_duck(cond)}) AS violating_rows FROM cl_{t}"
        for t, n, cond in CONSTRAINTS
    )


INVALID_ROWS = (
    "SELECT 'payments' AS table_name, 'payment_installments_less_than_one' AS issue, "
    "order_id || ' + ' || CAST(payment_sequential AS VARCHAR) AS record_key, CAST(payment_installments AS DOUBLE) AS value "
    "FROM raw_payments WHERE payment_installments < 1"
    + U
    + "SELECT 'products', 'nonpositive_product_weight', product_id, CAST(product_weight_g AS DOUBLE) FROM raw_products WHERE product_weight_g <= 0"
)


def numeric_treatment() -> str:
    counts = [
        "SELECT COUNT(*) FROM raw_payments WHERE payment_installments < 1",
        "SELECT COUNT(*) FROM raw_products WHERE product_weight_g IS NOT NULL AND product_weight_g <= 0",
        "SELECT COUNT(*) FROM cl_orders WHERE has_timestamp_anomaly OR has_status_date_mismatch",
    ]
    return U.join(
        f"SELECT '{t}' AS table_name, '{i}' AS issue, CAST(({q}) AS BIGINT) AS affected_rows, '{tr}' AS treatment"
        for (t, i, tr), q in zip(TREATMENTS, counts)
    )


def final_key_checks() -> str:
    parts = []
    for t, keys in FINAL_KEYS.items():
        k = ", ".join(keys)
        anynull = " OR ".join(f"{x} IS NULL" for x in keys)
        parts.append(
            f"SELECT '{t}' AS table_name, '{' + '.join(keys)}' AS key_columns, nulls AS null_key_rows, dup AS duplicate_key_rows, "
            f"nulls = 0 AND dup = 0 AS key_valid FROM (SELECT (SELECT COUNT(*) FROM cl_{t} WHERE {anynull}) AS nulls, "
            f"(SELECT COALESCE(SUM(n) FILTER (WHERE n > 1), 0) FROM (SELECT COUNT(*) AS n FROM cl_{t} GROUP BY {k})) AS dup)"
        )
    return U.join(parts)


def key_checks() -> str:
    parts = []
    for t, keys, expectation in CANDIDATE_KEYS:
        k = ", ".join(keys)
        anynull = " OR ".join(f"{x} IS NULL" for x in keys)
        parts.append(
            f"SELECT '{t}' AS table_name, '{' + '.join(keys)}' AS candidate_key, total AS total_rows, uniq AS unique_combinations, "
            f"nulls AS null_key_rows, dup AS duplicate_key_rows, nulls = 0 AND dup = 0 AS is_valid_key, '{expectation}' AS expectation "
            f"FROM (SELECT (SELECT COUNT(*) FROM raw_{t}) AS total, (SELECT COUNT(*) FROM raw_{t} WHERE {anynull}) AS nulls, "
            f"(SELECT COUNT(*) FROM (SELECT 1 FROM raw_{t} WHERE NOT ({anynull}) GROUP BY {k})) AS uniq, "
            f"(SELECT COALESCE(SUM(n) FILTER (WHERE n > 1), 0) FROM (SELECT COUNT(*) AS n FROM raw_{t} WHERE NOT ({anynull}) GROUP BY {k})) AS dup)"
        )
    return U.join(parts)


def foreign_key_checks() -> str:
    parts = []
    for child, ck, parent, pk in FOREIGN_KEYS:
        parts.append(
            f"SELECT '{child}.{ck} -> {parent}.{pk}' AS relationship, rows AS child_rows, nulls AS child_null_rows, orph AS orphan_rows, "
            f"orph_u AS orphan_unique_values, {pct('rows - nulls - orph', 'rows - nulls')} AS coverage_pct, orph = 0 AS relationship_valid "
            f"FROM (SELECT (SELECT COUNT(*) FROM raw_{child}) AS rows, (SELECT COUNT(*) FROM raw_{child} WHERE {ck} IS NULL) AS nulls, "
            f"COUNT(*) AS orph, COUNT(DISTINCT {ck}) AS orph_u FROM raw_{child} c WHERE {ck} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM raw_{parent} p WHERE p.{pk} = c.{ck}))"
        )
    return U.join(parts)


def schema_overview() -> str:
    parts = []
    for t, cols in RAW_COLUMNS.items():
        for c, typ in cols:
            parts.append(
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{typ}' AS data_type, COUNT(*) AS row_count, "
                f"COUNT({c}) AS non_null_count, COUNT(*) - COUNT({c}) AS missing_count, "
                f"{pct(f'COUNT(*) - COUNT({c})', 'COUNT(*)')} AS missing_pct, COUNT(DISTINCT {c}) AS unique_count FROM raw_{t}"
            )
    return U.join(parts)


def data_type_checks() -> str:
    return U.join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{typ}' AS data_type, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_values FROM cl_{t}"
        for t, cols in CLEAN_COLUMNS.items()
        for c, typ in cols
    )


def dataset_inventory() -> str:
    parts = []
    for t, cols in RAW_COLUMNS.items():
        miss = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c, _ in cols)
        parts.append(
            f"SELECT '{t}' AS table_name, COUNT(*) AS rows, {len(cols)} AS columns, "
            f"COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw_{t})) AS duplicate_rows, "
            f"COALESCE(SUM({miss}), 0) AS missing_cells FROM raw_{t}"
        )
    return U.join(parts)


def cleaning_summary() -> str:
    return U.join(
        f"SELECT '{t}' AS table_name, (SELECT COUNT(*) FROM raw_{t}) AS raw_rows, (SELECT COUNT(*) FROM cl_{t}) AS clean_rows, "
        f"(SELECT COUNT(*) FROM cl_{t}) - (SELECT COUNT(*) FROM raw_{t}) AS row_change, {len(RAW_COLUMNS[t])} AS raw_columns, "
        f"{len(CLEAN_COLUMNS[t])} AS clean_columns"
        for t in RAW_COLUMNS
    )


def table_row_counts() -> str:
    return U.join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM cl_{t}" for t in CLEAN_COLUMNS)


# ------------------------------------------------------------------ report frames
PEAK_MONTH = f"""
SELECT
  (SELECT sales_month FROM v_monthly_sales WHERE sales_month >= DATE '{TREND_START}'
     ORDER BY payment_value_total DESC, sales_month LIMIT 1) AS peak_sales_month,
  (SELECT MAX(payment_value_total) FROM v_monthly_sales WHERE sales_month >= DATE '{TREND_START}') AS peak_payment_value,
  (SELECT sales_month FROM v_monthly_sales WHERE sales_month >= DATE '{TREND_START}'
     ORDER BY order_count DESC, sales_month LIMIT 1) AS peak_orders_month,
  (SELECT MAX(order_count) FROM v_monthly_sales WHERE sales_month >= DATE '{TREND_START}') AS peak_order_count"""

GROWTH_SIGN = f"""
SELECT activity_month, active_customer_count, active_customer_growth_pct,
  CASE WHEN active_customer_growth_pct >= 0 THEN 'growth' ELSE 'decline' END AS growth_direction
FROM v_monthly_customer_growth
WHERE activity_month >= DATE '{TREND_START}'
  AND activity_month > (SELECT MIN(activity_month) FROM v_monthly_customer_growth WHERE activity_month >= DATE '{TREND_START}')"""

HEATMAP = (
    "WITH long AS ("
    + U.join(
        f"SELECT cohort_month, cohort_size, 'M{i}' AS month_label, {i} AS month_offset, CAST(month_{i} AS DOUBLE) AS retention_pct "
        f"FROM v_cohort_retention_matrix_12m"
        for i in range(1, 13)
    )
    + f") SELECT strftime(cohort_month, '%Y-%m') || ' (n=' || format('{{:,}}', cohort_size) || ')' AS cohort_label, cohort_month, "
    f"month_label, month_offset, retention_pct, "
    f"(SELECT LEAST(GREATEST(quantile_cont(retention_pct, {HEATMAP_QUANTILE}), {HEATMAP_MIN}), {HEATMAP_MAX}) FROM long) AS heatmap_max FROM long"
)

SEGMENT_DISTRIBUTION = "SELECT customer_segment, customer_count, customer_share_pct FROM v_customer_segment_summary"

_INITCAP = "array_to_string(list_transform(string_split(replace(product_category_name_english, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
TOP_CATEGORIES = (
    f"SELECT product_category_name_english, {_INITCAP} AS category_label, item_price_total, freight_share_pct, "
    "(SELECT " + pct("SUM(freight_total)", "SUM(item_price_total + freight_total)", num_scale=2, den_scale=2)
    + " FROM v_category_performance) AS overall_freight_share_pct "
    "FROM v_category_performance ORDER BY item_price_total DESC, product_category_name_english LIMIT 10"
)


def _case_order(col: str, values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{v}' THEN {i}" for i, v in enumerate(values)) + f" ELSE {len(values)} END"


DELIVERY_COMPARISON = f"SELECT *, {_case_order('delivery_status', DELIVERY_STATUS_ORDER)} AS display_order FROM v_delivery_review_impact"

STATE_SCATTER = f"""
WITH s AS (
  SELECT * FROM v_state_delivery_performance
  WHERE average_delivery_days IS NOT NULL AND late_delivery_rate_pct IS NOT NULL AND average_review_score IS NOT NULL
)
SELECT customer_state, completed_order_count, CAST(average_delivery_days AS DOUBLE) AS average_delivery_days,
  CAST(late_delivery_rate_pct AS DOUBLE) AS late_delivery_rate_pct, CAST(average_review_score AS DOUBLE) AS average_review_score,
  (SELECT CAST(average_delivery_days AS DOUBLE) FROM v_operations_kpis) AS overall_delivery_days,
  (SELECT CAST(late_delivery_rate_pct AS DOUBLE) FROM v_operations_kpis) AS overall_late_rate,
  {BUBBLE_BASE} + {BUBBLE_SCALE} * sqrt(completed_order_count / (SELECT MAX(completed_order_count) FROM s)) AS bubble_size
FROM s"""

RISK_SUMMARY = (
    "SELECT seller_risk_segment, COUNT(*) AS seller_count, COUNT(*) FILTER (WHERE is_high_value_seller) AS high_value_seller_count, "
    "SUM(item_price_total) AS item_price_total, "
    + rdiv("SUM(late_delivery_rate_pct)", "COUNT(late_delivery_rate_pct)", 6, num_scale=2)
    + " AS mean_late_delivery_rate_pct, "
    + rdiv("SUM(low_review_rate_pct)", "COUNT(low_review_rate_pct)", 6, num_scale=2)
    + " AS mean_low_review_rate_pct, "
    + _case_order("seller_risk_segment", RISK_SEGMENT_ORDER)
    + " AS display_order FROM v_seller_risk GROUP BY seller_risk_segment"
)


def bodies(manual_rows: int) -> dict[str, str]:
    return {
        "clean_dates": clean_dates(),
        "clean_zip": clean_zip(),
        "clean_text": clean_text(),
        "clean_categories": clean_categories(manual_rows),
        "untranslated_categories": UNTRANSLATED,
        "clean_geolocation": clean_geolocation(),
        "zip_coverage": zip_coverage(),
        "order_timestamp_checks": order_timestamp_checks(),
        "order_flags": "SELECT order_id, order_status, has_timestamp_anomaly, has_status_date_mismatch, is_valid_delivery_record FROM cl_orders",
        "status_counts": STATUS,
        "numeric_profile": numeric_profile(),
        "business_rules": business_rules(),
        "constraint_checks": constraint_checks(),
        "invalid_rows": INVALID_ROWS,
        "numeric_treatment": numeric_treatment(),
        "final_key_checks": final_key_checks(),
        "key_checks": key_checks(),
        "foreign_key_checks": foreign_key_checks(),
        "schema_overview": schema_overview(),
        "data_type_checks": data_type_checks(),
        "dataset_inventory": dataset_inventory(),
        "cleaning_summary": cleaning_summary(),
        "table_row_counts": table_row_counts(),
        "peak_month": PEAK_MONTH,
        "growth_sign": GROWTH_SIGN,
        "retention_heatmap_frame": HEATMAP,
        "segment_distribution": SEGMENT_DISTRIBUTION,
        "top_categories_frame": TOP_CATEGORIES,
        "delivery_comparison": DELIVERY_COMPARISON,
        "state_scatter_frame": STATE_SCATTER,
        "risk_summary_frame": RISK_SUMMARY,
        "final_assertions": final_assertions(),
        "model_profile": MODEL_PROFILE,
        "share_checks": SHARE_CHECKS,
        "model_fingerprints": model_fingerprints(),
        "rejected_payments": REJECTED_PAYMENTS,
    }


__all__ = ["bodies", "STD", "avg"]


def final_assertions() -> str:
    pf = " + ".join(
        f"(SELECT COUNT(*) FROM raw_{t} WHERE " + " OR ".join(f"({c} IS NOT NULL AND {_ts(c)} IS NULL)" for c in cols) + ")"
        for t, cols in DATE_COLUMNS.items()
    )
    rows = [
        ("no_date_parse_failures", pf),
        ("every_product_has_english_category", "(SELECT COUNT(*) FROM cl_products WHERE product_category_name_english IS NULL)"),
        ("one_geolocation_row_per_zip", "(SELECT COUNT(*) - COUNT(DISTINCT geolocation_zip_code_prefix) FROM cl_geolocation)"),
        ("installments_at_least_one", "(SELECT COUNT(*) FROM cl_payments WHERE payment_installments < 1)"),
        ("weights_positive_when_present", "(SELECT COUNT(*) FROM cl_products WHERE product_weight_g <= 0)"),
        (
            "order_flags_not_null",
            "(SELECT COUNT(*) FROM cl_orders WHERE has_timestamp_anomaly IS NULL OR has_status_date_mismatch IS NULL "
            "OR is_valid_delivery_record IS NULL)",
        ),
    ]
    rows += [
        (f"row_count_unchanged_{t}", f"ABS((SELECT COUNT(*) FROM raw_{t}) - (SELECT COUNT(*) FROM cl_{t}))")
        for t in ["customers", "order_items", "payments", "reviews", "orders", "products", "sellers"]
    ]
    return U.join(f"SELECT '{n}' AS assertion, CAST({q} AS BIGINT) AS failing_rows, CAST({q} AS BIGINT) = 0 AS passed" for n, q in rows)


MODEL_PROFILE = (
    "SELECT COUNT(*) AS order_count, COUNT(*) FILTER (WHERE NOT has_item_record) AS orders_without_items, "
    "COUNT(*) FILTER (WHERE NOT has_payment_record) AS orders_without_payments, "
    "COUNT(*) FILTER (WHERE NOT has_review_record) AS orders_without_reviews, "
    "SUM(item_count) AS reconstructed_item_count, SUM(review_record_count) AS reconstructed_review_count FROM v_order_summary"
)
SHARE_CHECKS = U.join(
    f"SELECT '{view}' AS view_name, CAST(SUM({column}) AS DECIMAL(18,4)) AS total_share_pct FROM v_{view}"
    for view, column in (("category_performance", "item_revenue_share_pct"), ("product_performance", "item_revenue_share_pct"), ("seller_performance", "seller_revenue_share_pct"))
)


def model_fingerprints() -> str:
    """Source and model rows by EXCEPT ALL both ways: rows of either side, and keys with a row that the other lacks."""
    line = "order_id, order_item_id, product_id, seller_id, price, freight_value"
    head = "order_id, customer_id, order_status, order_purchase_timestamp, order_delivered_customer_date, is_valid_delivery_record"
    money = "CAST(COALESCE({0}, 0) AS DECIMAL(18,2))"
    pairs = [
        ("items_in_item_detail", f"SELECT {line} FROM cl_order_items", f"SELECT {line} FROM v_order_item_detail"),
        ("orders_in_order_summary", f"SELECT {head} FROM cl_orders", f"SELECT {head} FROM v_order_summary"),
        (
            "item_totals_of_orders",
            f"SELECT order_id, COUNT(*), {money.format('SUM(price)')}, {money.format('SUM(freight_value)')} FROM cl_order_items GROUP BY order_id",
            f"SELECT order_id, item_count, {money.format('item_price_total')}, {money.format('freight_total')} FROM v_order_summary WHERE has_item_record",
        ),
        (
            "payment_totals_of_orders",
            f"SELECT order_id, COUNT(*), {money.format('SUM(payment_value)')} FROM cl_payments GROUP BY order_id",
            f"SELECT order_id, payment_record_count, {money.format('payment_value_total')} FROM v_order_summary WHERE has_payment_record",
        ),
        (
            "review_counts_of_orders",
            "SELECT order_id, COUNT(*), MIN(review_score) FROM cl_reviews GROUP BY order_id",
            "SELECT order_id, review_record_count, minimum_review_score FROM v_order_summary WHERE has_review_record",
        ),
        (
            "months_of_customers",
            "SELECT customer_unique_id, date_trunc('month', order_purchase_timestamp), COUNT(*) FROM cl_orders JOIN cl_customers USING (customer_id) GROUP BY ALL",
            "SELECT customer_unique_id, activity_month, monthly_order_count FROM v_customer_monthly_activity",
        ),
    ]
    out = []
    for name, a, b in pairs:
        key = "customer_unique_id" if name == "months_of_customers" else "order_id"
        differ = f"(SELECT COUNT(DISTINCT {key}) FROM ((({a}) EXCEPT ALL ({b})) UNION ALL (({b}) EXCEPT ALL ({a}))))"
        out.append(
            f"SELECT '{name}' AS check_name, (SELECT COUNT(*) FROM ({a})) AS source_rows, (SELECT COUNT(*) FROM ({b})) AS model_rows, "
            f"{differ} AS differing_keys, {differ} = 0 AS passed"
        )
    return U.join(out)


_FATE = "CAST('0x' || substr(md5(order_id || ':' || payment_sequential), 1, 8) AS BIGINT) % 100"
REJECTED_PAYMENTS = f"""
SELECT CASE WHEN fate < 3 THEN 'too many columns' WHEN fate < 5 THEN 'too few columns' WHEN fate < 9 THEN 'payment_value is not double' ELSE 'accepted' END AS reason,
       COUNT(*) AS rows, COUNT(*) FILTER (WHERE fate >= 9 AND payment_value IS NULL) AS without_value
FROM (SELECT payment_value, {_FATE} AS fate FROM raw_payments) GROUP BY 1
"""
