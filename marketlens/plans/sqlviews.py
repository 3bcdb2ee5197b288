"""DuckDB SQL of the reports (V08-V32) for ``oracle_sql()``, written from the rules in SURVEY 2.1.

The reports are described, not spelt out: a report is a relation, its group key and named measures,
and the measures that many reports share stand here once. Other derivations than on the Spark side
are used throughout: calendars are rows of zeros stacked under the data and summed with it, the
previous month is found by joining on the month number, ranks and running sums come from grouped distinct
values, quantile groups from row numbers by division, segments from a table of all score triples,
and a customer's last place from an ordered list.
"""

from __future__ import annotations

from itertools import product

from marketlens.functions.sqltext import avg, count_if, pct, rdiv
from marketlens.operators.rfm import RECENCY_BANDS
from marketlens.operators.sales import CONCENTRATION_THRESHOLDS

COMPLETED = "order_status = 'delivered' AND payment_value_total IS NOT NULL"
VALID = "is_valid_delivery_record"
LATE = "is_valid_delivery_record AND is_late_delivery"
POOR = "average_review_score <= 2"
REVIEWED = "has_review_record"
BREACH = "shipped_after_shipping_limit"
SAME = "is_same_state_delivery"


# ---------------------------------------------------------------- building blocks
def relation(name: str, source: str, key: dict[str, str], measures: dict[str, str], where: str = "") -> str:
    """One CTE: measures of ``source`` by ``key`` (no key: one row)."""
    columns = ", ".join(f"{sql} AS {out}" for out, sql in (key | measures).items())
    grouped = f" GROUP BY {', '.join(key.values())}" if key else ""
    return f"{name} AS (SELECT {columns} FROM {source}{f' WHERE {where}' if where else ''}{grouped})"


def derived(name: str, source: str, columns: dict[str, str]) -> str:
    """One CTE: ``source`` with columns added."""
    return f"{name} AS (SELECT *, {', '.join(f'{sql} AS {out}' for out, sql in columns.items())} FROM {source})"


def money_rate(num: str, den: str) -> str:
    """Money by count, two decimals."""
    return rdiv(num, den, 2, num_scale=2)


def money_pct(num: str, den: str, digits: int = 2) -> str:
    return pct(num, den, digits, num_scale=2, den_scale=2)


def number_of_month(d: str) -> str:
    return f"(12 * year({d}) + month({d}) - 1)"


def month_of_number(n: str) -> str:
    return f"make_date(CAST(({n}) // 12 AS INTEGER), CAST(({n}) % 12 + 1 AS INTEGER), 1)"


def total(column: str) -> str:
    return f"coalesce(sum({column}), 0)"


def quantile_group(position: str, size: str, groups: int) -> str:
    """Group 1 .. ``groups`` of a row by its position (from 1): the first ``size`` % ``groups`` groups have one row more."""
    large = f"({size} // {groups} + 1)"
    border = f"(({size} % {groups}) * {large})"
    return (
        f"(CASE WHEN {position} <= {border} THEN ({position} + {large} - 1) // {large} "
        f"ELSE {size} % {groups} + ({position} - {border} - 1) // greatest({size} // {groups}, 1) + 1 END)"
    )


DELIVERIES = {
    "valid_delivery_order_count": count_if(VALID),
    "late_delivery_order_count": count_if(LATE),
    "late_delivery_rate_pct": pct(count_if(LATE), count_if(VALID)),
    "average_delivery_days": avg("delivery_days", where=VALID),
}
ESTIMATED = {"average_estimated_delivery_days": avg("estimated_delivery_days", where=VALID)}
HANDLING = {"average_carrier_handling_days": avg("carrier_handling_days", where=VALID)}
DELAY = {"average_delivery_delay_days": avg("delivery_delay_days", where=VALID)}
DELAY_WHEN_LATE = {"average_delay_days_when_late": avg("delivery_delay_days", where=LATE)}
REVIEWS = {
    "reviewed_order_count": count_if(REVIEWED),
    "average_review_score": avg("average_review_score", scale=2, where=REVIEWED),
    "low_review_order_count": count_if(POOR),
    "low_review_rate_pct": pct(count_if(POOR), count_if(REVIEWED)),
}
BREACHES = {"shipping_limit_breach_count": count_if(BREACH), "shipping_limit_breach_rate_pct": pct(count_if(BREACH), "count(*)")}


def same_state(name: str) -> dict[str, str]:
    return {name: count_if(SAME), "same_state_delivery_rate_pct": pct(count_if(SAME), f"count({SAME})")}


FREIGHT_OF_ORDER = f"({total('item_price_total')} + {total('freight_total')})"
FREIGHT_SHARE = {"freight_share_pct": money_pct(total("freight_total"), FREIGHT_OF_ORDER)}


# ---------------------------------------------------------------- customers
def customers() -> list[str]:
    times = {"timestamp": "order_purchase_timestamp", "date": "purchase_date"}
    measures = {f"{edge}_order_{k}": f"{agg}({c})" for k, c in times.items() for edge, agg in (("first", "min"), ("last", "max"))}
    measures |= {
        "place": "list({'z': customer_zip_code_prefix, 'c': customer_city, 's': customer_state} ORDER BY order_purchase_timestamp DESC, order_id DESC)[1]",
        "order_count": "count(*)",
        "delivered_order_count": count_if("order_status = 'delivered'"),
        "canceled_order_count": count_if("order_status = 'canceled'"),
        "paid_order_count": count_if("has_payment_record"),
        "reviewed_order_count": count_if(REVIEWED),
        "total_item_count": total("item_count"),
        "total_product_value": total("item_price_total"),
        "total_freight_value": total("freight_total"),
        "total_gross_item_value": total("gross_item_value"),
        "total_payment_value": total("payment_value_total"),
        "average_order_payment": avg("payment_value_total", scale=2),
        "average_items_per_order": avg("item_count"),
        "average_review_score": avg("average_review_score", scale=2),
    } | DELIVERIES
    more = {
        "latest_zip_code_prefix": "place.z",
        "latest_customer_city": "place.c",
        "latest_customer_state": "place.s",
        "first_order_month": month_of_number(number_of_month("first_order_timestamp")),
        "last_order_month": month_of_number(number_of_month("last_order_timestamp")),
        "customer_relationship_days": "date_diff('day', first_order_date, last_order_date)",
        "repeat_order_count": "order_count - 1",
        "is_repeat_customer": "order_count >= 2",
    }
    return [relation("c_customers", "v_order_summary", {"customer_unique_id": "customer_unique_id"}, measures), derived("v_customer_summary", "c_customers", more)]


def activity() -> list[str]:
    month = number_of_month("purchase_month")
    monthly = {
        "monthly_order_count": "count(*)",
        "monthly_delivered_order_count": count_if("order_status = 'delivered'"),
        "monthly_item_count": "sum(item_count)",
        "monthly_payment_value": total("payment_value_total"),
        "monthly_average_order_payment": avg("payment_value_total", scale=2),
    }
    place = {
        "cohort": "min(m) OVER (PARTITION BY customer_unique_id)",
        "age": "m - min(m) OVER (PARTITION BY customer_unique_id)",
    }
    named = {
        "cohort_month": month_of_number("cohort"),
        "activity_month": month_of_number("m"),
        "months_since_first_order": "age",
        "is_new_customer": "age = 0",
        "is_returning_customer": "age > 0",
    }
    by_month = {
        "active_customer_count": "count(*)",
        "new_customer_count": count_if("age = 0"),
        "returning_customer_count": count_if("age > 0"),
        "multi_order_customer_count": count_if("monthly_order_count >= 2"),
        "order_count": "sum(monthly_order_count)",
        "delivered_order_count": "sum(monthly_delivered_order_count)",
        "item_count": "sum(monthly_item_count)",
        "payment_value": "sum(monthly_payment_value)",
        "average_payment_per_order": money_rate("sum(monthly_payment_value)", "sum(monthly_order_count)"),
        "orders_per_active_customer": rdiv("sum(monthly_order_count)", "count(*)"),
        "new_customer_rate_pct": pct(count_if("age = 0"), "count(*)"),
        "returning_customer_rate_pct": pct(count_if("age > 0"), "count(*)"),
    }
    counted = ["active_customer_count", "new_customer_count", "returning_customer_count", "order_count", "payment_value"]
    grown = {"active_customer": "active_customer_count", "new_customer": "new_customer_count", "payment": "payment_value"}
    previous = ", ".join(f"before.{c} AS previous_{c}" for c in grown.values())
    growth = ", ".join(f"{money_pct(f'g.{c} - before.{c}', f'before.{c}')} AS {n}_growth_pct" for n, c in grown.items())
    return [
        relation("c_months", "v_order_summary", {"customer_unique_id": "customer_unique_id", "m": month}, monthly),
        derived("c_aged", "c_months", place),
        derived("v_customer_monthly_activity", "c_aged", named),
        relation("v_monthly_customer_metrics", "v_customer_monthly_activity", {"activity_month": "activity_month", "m": "m"}, by_month),
        # a row of zeros for every month of the span, summed with the months that have customers
        f"""c_calendar AS (
  SELECT m, {', '.join(f'sum({c}) AS {c}' for c in counted)} FROM (
    SELECT m, {', '.join(counted)} FROM v_monthly_customer_metrics
    UNION ALL SELECT unnest(range(min(m), max(m) + 1)), {', '.join('0' for _ in counted)} FROM v_monthly_customer_metrics
  ) WHERE m IS NOT NULL GROUP BY m)""",
        f"""v_monthly_customer_growth AS (
  SELECT {month_of_number('g.m')} AS activity_month, g.* EXCLUDE (m), {previous}, {growth}
  FROM c_calendar g LEFT JOIN c_calendar before ON before.m + 1 = g.m)""",
    ]


def cohorts() -> list[str]:
    cohort = {"cohort": "cohort", "age": "age"}
    sums = {"active_customer_count": "sum(a)", "order_count": "sum(o)", "payment_value": "sum(p)"}
    rates = {
        "cohort_month": month_of_number("cohort"),
        "activity_month": month_of_number("cohort + age"),
        "months_since_first_order": "age",
        "inactive_customer_count": "cohort_size - active_customer_count",
        "retention_rate_pct": pct("active_customer_count", "cohort_size"),
        "orders_per_active_customer": rdiv("order_count", "active_customer_count"),
        "payment_per_active_customer": money_rate("payment_value", "active_customer_count"),
    }
    year = "months_since_first_order BETWEEN 0 AND 12"
    return [
        "c_last AS (SELECT max(m) AS m FROM c_aged)",
        relation("c_sizes", "c_aged", {"cohort": "cohort"}, {"cohort_size": count_if("age = 0")}),
        # every cohort and age up to the last month, as zeros, and the active customers as ones
        """c_cells AS (
  SELECT cohort, unnest(range(0, c_last.m - cohort + 1)) AS age, 0 AS a, 0 AS o, 0 AS p FROM c_sizes, c_last
  UNION ALL SELECT cohort, age, 1, monthly_order_count, monthly_payment_value FROM c_aged)""",
        relation("c_sums", "c_cells", cohort, sums, "cohort IS NOT NULL"),
        derived("v_customer_cohort_retention", "(SELECT * FROM c_sums JOIN c_sizes USING (cohort))", rates),
        # ages are gap-free, so the list of rates by age is the row of the matrix
        "c_rows AS (SELECT cohort_month, cohort_size, list(retention_rate_pct ORDER BY age) AS rates FROM v_customer_cohort_retention GROUP BY ALL)",
        f"v_cohort_retention_matrix_12m AS (SELECT cohort_month, cohort_size, {', '.join(f'rates[{i + 1}] AS month_{i}' for i in range(13))} FROM c_rows)",
        relation(
            "v_cohort_retention_benchmark",
            "v_customer_cohort_retention",
            {"months_since_first_order": "months_since_first_order"},
            {
                "observed_cohort_count": "count(*)",
                "combined_cohort_size": "sum(cohort_size)",
                "active_customer_count": "sum(active_customer_count)",
                "weighted_retention_rate_pct": pct("sum(active_customer_count)", "sum(cohort_size)"),
                "average_cohort_retention_pct": avg("retention_rate_pct", scale=2),
                "minimum_cohort_retention_pct": "min(retention_rate_pct)",
                "maximum_cohort_retention_pct": "max(retention_rate_pct)",
            },
            year,
        ),
    ]


def segment_of(r: int, f: int, m: int) -> str:
    """The segment names and score limits of the report, the first that holds."""
    rules = [
        (r >= 4 and f >= 3 and m >= 4, "Champions"),
        (r >= 3 and f >= 3, "Loyal Customers"),
        (r >= 4 and f == 2, "Potential Loyalists"),
        (r == 5 and f == 1, "New Customers"),
        (r >= 4 and f == 1, "Promising"),
        (r <= 2 and m >= 4, "High Value at Risk"),
        (r <= 2 and f >= 2, "At Risk"),
        (r <= 2 and f == 1, "Hibernating"),
    ]
    return next((name for holds, name in rules if holds), "Need Attention")


def rfm() -> list[str]:
    scores = range(1, 6)
    triples = [f"({r}, {f}, {m}, '{segment_of(r, f, m)}')" for r, f, m in product(scores, scores, scores)]
    triples.append("(0, 0, 0, 'No Completed Purchase')")
    recency = " + ".join(f"CAST(recency_days <= {limit} AS INTEGER)" for limit, _ in RECENCY_BANDS)
    bought = {
        "first_completed_order_date": "min(purchase_date)",
        "last_completed_order_date": "max(purchase_date)",
        "n": "count(*)",
        "paid": "sum(payment_value_total)",
        "average_completed_order_payment": avg("payment_value_total", scale=2),
    }
    buyers = count_if("completed_order_count > 0")
    again = count_if("completed_order_count >= 2")
    repeat = count_if("is_repeat_customer")
    return [
        relation("c_buyers", "v_order_summary", {"customer_unique_id": "customer_unique_id"}, bought, "order_status = 'delivered' AND has_payment_record"),
        "c_today AS (SELECT max(last_completed_order_date) + 1 AS analysis_reference_date FROM c_buyers)",
        """c_ordered AS (
  SELECT *, date_diff('day', last_completed_order_date, analysis_reference_date) AS recency_days,
    row_number() OVER (ORDER BY paid, customer_unique_id) AS place, (SELECT count(*) FROM c_buyers) AS size
  FROM c_buyers, c_today)""",
        f"""c_scored AS (
  SELECT *, 1 + {recency} AS recency_score, least(n, 5) AS frequency_score, {quantile_group('place', 'size', 5)} AS monetary_score
  FROM c_ordered)""",
        f"c_segments AS (SELECT * FROM (VALUES {', '.join(triples)}) AS t(recency_score, frequency_score, monetary_score, customer_segment))",
        """c_all_scores AS (
  SELECT c.customer_unique_id, c.latest_customer_state, c.order_count AS all_order_count, c.total_payment_value AS all_order_payment_value,
    c.is_repeat_customer, s.* EXCLUDE (customer_unique_id, n, paid, place, size, recency_score, frequency_score, monetary_score),
    coalesce(n, 0) AS completed_order_count, coalesce(paid, 0) AS monetary_value, coalesce(recency_score, 0) AS recency_score,
    coalesce(frequency_score, 0) AS frequency_score, coalesce(monetary_score, 0) AS monetary_score
  FROM v_customer_summary c LEFT JOIN c_scored s USING (customer_unique_id))""",
        """v_customer_rfm AS (
  SELECT *, recency_score + frequency_score + monetary_score AS rfm_total_score,
    CAST(100 * recency_score + 10 * frequency_score + monetary_score AS VARCHAR) AS plain_code
  FROM c_all_scores LEFT JOIN c_segments USING (recency_score, frequency_score, monetary_score))""",
        "c_rfm_coded AS (SELECT * EXCLUDE (plain_code), lpad(plain_code, 3, '0') AS rfm_code FROM v_customer_rfm)",
        relation(
            "c_by_segment",
            "v_customer_rfm",
            {"customer_segment": "customer_segment"},
            {
                "customer_count": "count(*)",
                "completed_order_count": "sum(completed_order_count)",
                "monetary_value": "sum(monetary_value)",
                "average_recency_days": avg("recency_days"),
                "average_completed_orders": avg("completed_order_count"),
                "average_customer_value": avg("monetary_value", scale=2),
            },
        ),
        derived("v_customer_segment_summary", "c_by_segment", {"customer_share_pct": pct("customer_count", "(SELECT count(*) FROM v_customer_rfm)")}),
        relation(
            "v_customer_kpi_summary",
            "v_customer_rfm",
            {},
            {
                "total_customer_count": "count(*)",
                "all_order_repeat_customer_count": repeat,
                "all_order_repeat_customer_rate_pct": pct(repeat, "count(*)"),
                "completed_purchase_customer_count": buyers,
                "no_completed_purchase_customer_count": f"count(*) - {buyers}",
                "completed_repeat_customer_count": again,
                "completed_repeat_customer_rate_pct": pct(again, buyers),
                "completed_order_count": "sum(completed_order_count)",
                "completed_payment_value": "sum(monetary_value)",
                "average_completed_order_value": money_rate("sum(monetary_value)", "sum(completed_order_count)"),
                "average_completed_customer_value": money_rate("sum(monetary_value)", buyers),
                "average_completed_orders_per_customer": rdiv("sum(completed_order_count)", buyers),
                "analysis_reference_date": "max(analysis_reference_date)",
            },
        ),
    ]


# ---------------------------------------------------------------- sales
def ranked(name: str, source: str, column: str, by: str) -> list[str]:
    """``source`` with the place of its value among the distinct values (``rank``), its position with ties by ``by`` (``position``)
    and the sum up to that position (``upto``), all from the grouped distinct values; ``all_value`` and ``all_rows`` beside."""
    above = f"OVER (ORDER BY {column} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return [
        f"{name}_values AS (SELECT {column}, count(*) AS rows_, sum({column}) AS sum_ FROM {source} GROUP BY {column})",
        f"""{name}_above AS (
  SELECT {column} AS value, row_number() OVER (ORDER BY {column} DESC) AS rank,
    coalesce(sum(rows_) {above}, 0) AS rows_above, coalesce(sum(sum_) {above}, 0) AS sum_above
  FROM {name}_values)""",
        f"""{name} AS (
  SELECT s.*, rank, rows_above + tie AS position, sum_above + tie * s.{column} AS upto,
    (SELECT sum({column}) FROM {source}) AS all_value, (SELECT count(*) FROM {source}) AS all_rows
  FROM (SELECT *, row_number() OVER (PARTITION BY {column} ORDER BY {by}) AS tie FROM {source}) s JOIN {name}_above a ON a.value = s.{column})""",
    ]


def sales() -> list[str]:
    summed = ["order_count", "customer_count", "item_count", "item_price_total", "freight_total", "payment_value_total"]
    month = {
        "order_count": "count(*)",
        "customer_count": "count(DISTINCT customer_unique_id)",
        "item_count": total("item_count"),
        "item_price_total": total("item_price_total"),
        "freight_total": total("freight_total"),
        "payment_value_total": "sum(payment_value_total)",
    }
    item_and_freight = "s.item_price_total + s.freight_total"
    item = {
        "order_count": "count(DISTINCT order_id)",
        "item_count": "count(*)",
        "seller_count": "count(DISTINCT seller_id)",
        "customer_count": "count(DISTINCT customer_unique_id)",
        "item_price_total": "sum(price)",
        "freight_total": "sum(freight_value)",
        "average_item_price": avg("price", scale=2),
    }
    category = {"product_category_name_english": "coalesce(product_category_name_english, 'unknown')"}
    prices = {
        "minimum_item_price": "min(price)",
        "maximum_item_price": "max(price)",
        "first_purchase_date": "min(purchase_date)",
        "last_purchase_date": "max(purchase_date)",
    }
    needed = ", ".join(
        f"({t}, (SELECT min(position) FROM v_product_performance WHERE cumulative_item_revenue_pct >= {t}))" for t in CONCENTRATION_THRESHOLDS
    )
    return [
        f"s_orders AS (SELECT * FROM v_order_summary WHERE {COMPLETED})",
        # items of completed orders
        "s_items AS (SELECT * FROM v_order_item_detail SEMI JOIN s_orders USING (order_id))",
        relation("s_months", "s_orders", {"m": number_of_month("purchase_date")}, month, "purchase_date IS NOT NULL"),
        f"""s_calendar AS (
  SELECT m, {', '.join(f'sum({c}) AS {c}' for c in summed)} FROM (
    SELECT * FROM s_months
    UNION ALL SELECT unnest(range(min(m), max(m) + 1)), {', '.join('0' for _ in summed)} FROM s_months
  ) GROUP BY m)""",
        f"""v_monthly_sales AS (
  SELECT {month_of_number('s.m')} AS sales_month, s.* EXCLUDE (m), {item_and_freight} AS item_and_freight_total,
    {money_rate('s.payment_value_total', 's.order_count')} AS average_order_value,
    {money_pct('s.freight_total', item_and_freight)} AS freight_share_pct,
    s.payment_value_total - ({item_and_freight}) AS payment_difference,
    {money_pct('s.payment_value_total - before.payment_value_total', 'before.payment_value_total')} AS payment_growth_pct
  FROM s_calendar s LEFT JOIN s_calendar before ON before.m + 1 = s.m)""",
        relation("s_categories", "s_items", category, item | {"product_count": "count(DISTINCT product_id)"}),
        *ranked("s_categories_ranked", "s_categories", "item_price_total", "product_category_name_english"),
        derived(
            "v_category_performance",
            "s_categories_ranked",
            {
                "item_and_freight_total": "item_price_total + freight_total",
                "average_items_per_order": rdiv("item_count", "order_count"),
                "freight_share_pct": money_pct("freight_total", "item_price_total + freight_total"),
                "item_revenue_share_pct": money_pct("item_price_total", "all_value"),
                "item_revenue_rank": "rank",
            },
        ),
        relation("s_products", "s_items", {"product_id": "product_id"} | category, item | prices),
        *ranked("s_products_ranked", "s_products", "item_price_total", "product_id"),
        derived(
            "v_product_performance",
            "s_products_ranked",
            {
                "item_revenue_rank": "rank",
                "item_revenue_share_pct": money_pct("item_price_total", "all_value", 4),
                "cumulative_item_revenue_pct": money_pct("upto", "all_value"),
            },
        ),
        f"""v_product_revenue_concentration AS (
  SELECT threshold_pct, products_required, size AS total_product_count, {pct('products_required', 'size')} AS product_share_required_pct
  FROM (VALUES {needed}) AS t(threshold_pct, products_required), (SELECT count(*) AS size FROM s_products))""",
        relation(
            "v_sales_kpis",
            "s_orders",
            {},
            {
                "completed_order_count": "count(*)",
                "completed_customer_count": "count(DISTINCT customer_unique_id)",
                "item_count": total("item_count"),
                "item_price_total": total("item_price_total"),
                "freight_total": total("freight_total"),
                "item_and_freight_total": FREIGHT_OF_ORDER,
                "payment_value_total": "sum(payment_value_total)",
                "average_order_value": avg("payment_value_total", scale=2),
                "average_items_per_order": rdiv(total("item_count"), "count(*)"),
                "payment_difference": f"sum(payment_value_total) - {FREIGHT_OF_ORDER}",
                "first_completed_purchase_date": "min(purchase_date)",
                "last_completed_purchase_date": "max(purchase_date)",
            }
            | FREIGHT_SHARE,
        ),
    ]


# ---------------------------------------------------------------- operations
def operations(high_value_rank: int) -> list[str]:
    seller = {c: c for c in ("order_id", "seller_id", "seller_city", "seller_state")}
    parts = {
        "item_count": "count(*)",
        "distinct_product_count": "count(DISTINCT product_id)",
        "category_count": "count(DISTINCT coalesce(product_category_name_english, 'unknown'))",
        "item_price_total": "sum(price)",
        "freight_total": "sum(freight_value)",
        "gross_item_value": "sum(price + freight_value)",
        BREACH: f"bool_or({BREACH})",
    }
    of_order = [
        "customer_unique_id", "customer_city", "customer_state", "purchase_date", "purchase_month", "carrier_handling_days",
        "delivery_days", "estimated_delivery_days", "delivery_delay_days", "is_late_delivery", "is_valid_delivery_record",
        "average_review_score", "has_review_record", "has_written_comment",
    ]
    measures = {
        "seller_city": "max(seller_city)",
        "seller_state": "max(seller_state)",
        "completed_order_count": "count(*)",
        "customer_count": "count(DISTINCT customer_unique_id)",
        "item_count": "sum(item_count)",
        "item_price_total": "sum(item_price_total)",
        "freight_total": "sum(freight_total)",
        "gross_item_value": "sum(gross_item_value)",
        "average_item_value_per_order": money_rate("sum(item_price_total)", "count(*)"),
        "average_items_per_order": rdiv("sum(item_count)", "count(*)"),
        "first_completed_purchase_date": "min(purchase_date)",
        "last_completed_purchase_date": "max(purchase_date)",
    } | DELIVERIES | HANDLING | DELAY_WHEN_LATE | BREACHES | REVIEWS | same_state("same_state_order_count")
    reach = {"distinct_product_count": "count(DISTINCT product_id)", "distinct_category_count": "count(DISTINCT coalesce(product_category_name_english, 'unknown'))"}
    monthly = DELIVERIES | ESTIMATED | HANDLING | DELAY | DELAY_WHEN_LATE | REVIEWS
    counts = ("valid_delivery_order_count", "late_delivery_order_count", "reviewed_order_count", "low_review_order_count")
    taken = ", ".join(f"coalesce(o.{c}, 0) AS {c}" if c in counts else f"o.{c}" for c in monthly)
    late = "CASE WHEN is_late_delivery THEN 'Late' ELSE 'On Time or Early' END"
    rates = {"late_delivery_quartile": "late_delivery_rate_pct", "shipping_breach_quartile": "shipping_limit_breach_rate_pct", "low_review_quartile": "low_review_rate_pct"}
    places = ", ".join(f"row_number() OVER (ORDER BY {c}, seller_id) AS place_{i}" for i, c in enumerate(rates.values()))
    quartiles = ", ".join(f"{quantile_group(f'place_{i}', 'size', 4)} AS {q}" for i, q in enumerate(rates))
    return [
        relation("o_parts", "v_order_item_detail", seller, parts),
        f"""v_seller_order_performance AS (
  SELECT o_parts.*, {', '.join('s_orders.' + c for c in of_order)}, s_orders.seller_count >= 2 AS is_multi_seller_order,
    seller_state = s_orders.customer_state AS {SAME}
  FROM o_parts JOIN s_orders USING (order_id))""",
        relation("o_reach", "s_items", {"seller_id": "seller_id"}, reach),
        relation("o_sellers", "v_seller_order_performance", {"seller_id": "seller_id"}, measures),
        *ranked("o_sellers_ranked", "o_sellers", "item_price_total", "seller_id"),
        derived(
            "v_seller_performance",
            "(SELECT * FROM o_sellers_ranked LEFT JOIN o_reach USING (seller_id))",
            {"seller_revenue_rank": "rank", "seller_revenue_share_pct": money_pct("item_price_total", "all_value", 4)},
        ),
        relation("o_months", "s_orders", {"purchase_month": "purchase_month"}, monthly),
        f"""v_monthly_delivery_performance AS (
  SELECT m.sales_month AS purchase_month, m.order_count AS completed_order_count, m.customer_count, m.payment_value_total, {taken}
  FROM v_monthly_sales m LEFT JOIN o_months o ON o.purchase_month = m.sales_month)""",
        relation(
            "v_state_delivery_performance",
            "s_orders",
            {"customer_state": "coalesce(customer_state, 'unknown')"},
            {
                "completed_order_count": "count(*)",
                "customer_count": "count(DISTINCT customer_unique_id)",
                "payment_value_total": "sum(payment_value_total)",
                "freight_total": total("freight_total"),
            }
            | FREIGHT_SHARE | DELIVERIES | ESTIMATED | DELAY | DELAY_WHEN_LATE | REVIEWS,
        ),
        relation("o_orders", "s_orders", {}, {"completed_order_count": "count(*)"} | monthly),
        relation("o_seller_orders", "v_seller_order_performance", {}, {"seller_order_count": "count(*)"} | BREACHES | same_state("same_state_seller_order_count")),
        "v_operations_kpis AS (SELECT * FROM o_orders, o_seller_orders)",
        relation(
            "v_delivery_review_impact",
            "s_orders",
            {"delivery_status": late},
            {
                "order_count": "count(*)",
                "average_delivery_days": avg("delivery_days"),
                "average_delivery_delay_days": avg("delivery_delay_days"),
                "written_comment_order_count": count_if("has_written_comment"),
                "written_comment_rate_pct": pct(count_if("has_written_comment"), count_if(REVIEWED)),
            }
            | REVIEWS,
            VALID,
        ),
        "o_eligible AS (SELECT * FROM v_seller_performance WHERE least(valid_delivery_order_count, reviewed_order_count) >= 20)",
        f"o_placed AS (SELECT *, {places}, (SELECT count(*) FROM o_eligible) AS size FROM o_eligible)",
        f"o_quartiles AS (SELECT *, {quartiles} FROM o_placed)",
        derived(
            "o_risk",
            "o_quartiles",
            {"operational_risk_score": " + ".join(rates), "is_high_value_seller": f"seller_revenue_rank <= {high_value_rank}"},
        ),
        # Labels and score limits
        derived(
            "v_seller_risk",
            "o_risk",
            {
                "seller_risk_segment": "CASE WHEN operational_risk_score < 7 THEN 'Stable' WHEN operational_risk_score < 10 THEN 'Monitor' "
                "WHEN is_high_value_seller THEN 'High-Value At Risk' ELSE 'High Risk' END"
            },
        ),
    ]


# ---------------------------------------------------------------- checks
def _count(source: str, where: str = "") -> str:
    return f"(SELECT count(*) FROM {source}{f' WHERE {where}' if where else ''})"


def _one(sql: str, source: str) -> str:
    return f"(SELECT {sql} FROM {source})"


def _repeated(source: str, *key: str) -> str:
    """Rows beyond one for each key."""
    return f"(SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(key)} FROM {source}))"


def _without(source: str, other: str, key: str) -> str:
    return f"(SELECT count(*) FROM {source} ANTI JOIN {other} USING ({key}))"


#: The names of the checks. A check is its actual and its expected number.
Checks = dict[str, tuple[str, str]]


def _rows(checks: Checks) -> str:
    return ", ".join(f"('{name}', CAST({actual} AS DECIMAL(38,2)), CAST({expected} AS DECIMAL(38,2)))" for name, (actual, expected) in checks.items())


def reconciliation(name: str, checks: Checks) -> str:
    """metric_name, expected_value, actual_value, difference, passed"""
    return f"""{name} AS (
  SELECT *, actual_value - expected_value AS difference, actual_value = expected_value AS passed
  FROM (VALUES {_rows(checks)}) AS t(metric_name, actual_value, expected_value))"""


def statuses(name: str, checks: Checks) -> str:
    """check_name, actual_value, expected_value, status"""
    return f"""{name} AS (
  SELECT *, CASE WHEN actual_value = expected_value THEN 'PASS' ELSE 'FAIL' END AS status
  FROM (VALUES {_rows(checks)}) AS t(check_name, actual_value, expected_value))"""


def sales_checks() -> Checks:
    price, freight = _one(total("item_price_total"), "s_orders"), _one(total("freight_total"), "s_orders")
    category, sold = "v_category_performance", "v_product_performance"
    return {
        "monthly_order_count": (_one("sum(order_count)", "v_monthly_sales"), _count("s_orders")),
        "monthly_payment_value": (_one("sum(payment_value_total)", "v_monthly_sales"), _one("sum(payment_value_total)", "s_orders")),
        "category_item_price": (_one("sum(item_price_total)", category), price),
        "category_freight": (_one("sum(freight_total)", category), freight),
        "product_item_price": (_one("sum(item_price_total)", sold), price),
        "product_freight": (_one("sum(freight_total)", sold), freight),
        "category_duplicate_grains": (_repeated(category, "product_category_name_english"), "0"),
        "product_duplicate_grains": (_repeated(sold, "product_id"), "0"),
    }


def operations_checks() -> Checks:
    completed = _count("s_orders")
    return {
        "monthly_completed_orders": (_one("sum(completed_order_count)", "v_monthly_delivery_performance"), completed),
        "state_completed_orders": (_one("sum(completed_order_count)", "v_state_delivery_performance"), completed),
        "overall_completed_orders": (_one("completed_order_count", "v_operations_kpis"), completed),
        "delivery_status_orders": (_one("sum(order_count)", "v_delivery_review_impact"), _count("s_orders", VALID)),
        "seller_duplicate_grains": (_repeated("v_seller_performance", "seller_id"), "0"),
        "seller_order_duplicate_grains": (_repeated("v_seller_order_performance", "order_id", "seller_id"), "0"),
    }


def database_checks(manual_rows: int) -> Checks:
    out = {}
    for t in ("category_translation", "customers", "geolocation", "order_items", "orders", "payments", "products", "reviews", "sellers"):
        expected = _count(f"raw_{t}")
        if t == "category_translation":
            expected += f" + {manual_rows}"
        if t == "geolocation":
            inside = "abs(geolocation_lat) <= 90 AND abs(geolocation_lng) <= 180"
            expected = f"(SELECT count(DISTINCT geolocation_zip_code_prefix) FROM raw_geolocation WHERE {inside})"
        out[f"row_count_{t}"] = (_count(f"cl_{t}"), expected)
    links = {
        "orders_customers": ("orders", "customers", "customer_id"),
        "items_orders": ("order_items", "orders", "order_id"),
        "items_products": ("order_items", "products", "product_id"),
        "items_sellers": ("order_items", "sellers", "seller_id"),
        "payments_orders": ("payments", "orders", "order_id"),
        "reviews_orders": ("reviews", "orders", "order_id"),
        "products_categories": ("products", "category_translation", "product_category_name"),
    }
    out |= {f"orphan_{n}": (_without(f"cl_{child}", f"cl_{parent}", key), "0") for n, (child, parent, key) in links.items()}
    bad = {
        "invalid_payment_installments": ("cl_payments", "payment_installments <= 0"),
        "non_positive_product_weights": ("cl_products", "product_weight_g <= 0"),
        "missing_english_categories": ("cl_products", "product_category_name_english IS NULL"),
        "invalid_geolocation_coordinates": ("cl_geolocation", "abs(geolocation_lat) > 90 OR abs(geolocation_lng) > 180"),
    }
    return out | {n: (_count(t, where), "0") for n, (t, where) in bad.items()}


def model_checks() -> Checks:
    orders, items = "v_order_summary", "v_order_item_detail"
    distinct_orders = {t: f"(SELECT count(DISTINCT order_id) FROM cl_{t})" for t in ("order_items", "payments", "reviews")}
    gross = _one("sum(price + freight_value)", "cl_order_items")
    return {
        "order_summary_row_count": (_count(orders), _count("cl_orders")),
        "order_summary_unique_orders": (_one("count(DISTINCT order_id)", orders), _count("cl_orders")),
        "item_detail_row_count": (_count(items), _count("cl_order_items")),
        "item_detail_unique_items": (f"(SELECT count(*) FROM (SELECT DISTINCT order_id, order_item_id FROM {items}))", _count("cl_order_items")),
        "items_aggregation_row_count": (_count("v_order_items_agg"), distinct_orders["order_items"]),
        "payments_aggregation_row_count": (_count("v_payments_agg"), distinct_orders["payments"]),
        "reviews_aggregation_row_count": (_count("v_reviews_agg"), distinct_orders["reviews"]),
        "order_summary_item_count_total": (_one("sum(item_count)", orders), _count("cl_order_items")),
        "order_summary_review_count_total": (_one("sum(review_record_count)", orders), _count("cl_reviews")),
        "item_price_total_reconciliation": (_one("sum(item_price_total)", "v_order_items_agg"), _one("sum(price)", "cl_order_items")),
        "freight_total_reconciliation": (_one("sum(freight_total)", "v_order_items_agg"), _one("sum(freight_value)", "cl_order_items")),
        "gross_item_total_reconciliation": (_one("sum(gross_item_value)", "v_order_items_agg"), gross),
        "payment_total_reconciliation": (_one("sum(payment_value_total)", "v_payments_agg"), _one("sum(payment_value)", "cl_payments")),
        "item_detail_gross_reconciliation": (_one("sum(gross_item_value)", items), gross),
        "missing_customer_unique_id": (_count(orders, "customer_unique_id IS NULL"), "0"),
        "missing_item_product_category": (_count(items, "product_category_name_english IS NULL"), "0"),
        "missing_item_seller": (_count(items, "seller_state IS NULL"), "0"),
        "invalid_valid_delivery_days": (_count(orders, f"{VALID} AND delivery_days < 0"), "0"),
        "late_delivery_flag_mismatch": (_count(orders, "(delivery_delay_days > 0) <> coalesce(is_late_delivery, delivery_delay_days <= 0)"), "0"),
        "orders_without_items": (_count(orders, "NOT has_item_record"), _without("cl_orders", "cl_order_items", "order_id")),
        "orders_without_payments": (_count(orders, "NOT has_payment_record"), _without("cl_orders", "cl_payments", "order_id")),
        "orders_without_reviews": (_count(orders, "NOT has_review_record"), _without("cl_orders", "cl_reviews", "order_id")),
    }


def customer_checks() -> Checks:
    summary, scores = "v_customer_summary", "v_customer_rfm"
    # straight from the clean tables: orders of each person
    persons = "(SELECT customer_unique_id, count(*) AS n FROM cl_orders JOIN cl_customers USING (customer_id) GROUP BY 1)"
    done = "(SELECT * FROM v_order_summary WHERE order_status = 'delivered' AND has_payment_record)"
    low = "least(recency_score, frequency_score, monetary_score)"
    high = "greatest(recency_score, frequency_score, monetary_score)"
    return {
        "customer_summary_row_count": (_count(summary), _count(persons)),
        "customer_summary_unique_customers": (_one("count(DISTINCT customer_unique_id)", summary), _count(persons)),
        "customer_summary_order_reconciliation": (_one("sum(order_count)", summary), _one("sum(n)", persons)),
        "repeat_customer_count": (_count(summary, "is_repeat_customer"), _count(persons, "n >= 2")),
        "one_time_customer_count": (_count(summary, "NOT is_repeat_customer"), _count(persons, "n = 1")),
        "monthly_new_customer_reconciliation": (_one("sum(new_customer_count)", "v_monthly_customer_metrics"), _count(persons)),
        "monthly_order_reconciliation": (_one("sum(order_count)", "v_monthly_customer_metrics"), _one("sum(n)", persons)),
        "monthly_customer_balance_mismatch": (_count("v_monthly_customer_metrics", "new_customer_count + returning_customer_count <> active_customer_count"), "0"),
        "negative_months_since_first_order": (_count("v_customer_monthly_activity", "months_since_first_order < 0"), "0"),
        "cohort_month_0_customer_reconciliation": (_one("sum(active_customer_count)", "v_customer_cohort_retention WHERE age = 0"), _count(persons)),
        "invalid_month_0_retention": (_count("v_customer_cohort_retention", "age = 0 AND retention_rate_pct <> 100"), "0"),
        "invalid_retention_rate": (_count("v_customer_cohort_retention", "abs(retention_rate_pct - 50) > 50"), "0"),
        "rfm_customer_row_count": (_count(scores), _count(persons)),
        "rfm_unique_customer_count": (_one("count(DISTINCT customer_unique_id)", scores), _count(persons)),
        "rfm_unsegmented_customers": (_count(scores, "customer_segment IS NULL"), "0"),
        "rfm_invalid_scores": (_count(scores, f"CASE WHEN completed_order_count = 0 THEN {high} <> 0 OR {low} <> 0 ELSE {low} < 1 OR {high} > 5 END"), "0"),
        "rfm_completed_order_reconciliation": (_one("sum(completed_order_count)", scores), _count(done)),
        "rfm_payment_value_reconciliation": (_one("sum(monetary_value)", scores), _one("sum(payment_value_total)", done)),
        "segment_customer_reconciliation": (_one("sum(customer_count)", "v_customer_segment_summary"), _count(persons)),
        "customers_without_completed_purchase": (
            _count(scores, "completed_order_count = 0"),
            f"{_count(persons)} - (SELECT count(DISTINCT customer_unique_id) FROM {done})",
        ),
    }


def view_ctes(high_value_rank: int, manual_rows: int) -> list[str]:
    """All report CTEs in dependency order."""
    return [
        *customers(),
        *activity(),
        *cohorts(),
        *rfm(),
        *sales(),
        *operations(high_value_rank),
        reconciliation("v_sales_validation", sales_checks()),
        reconciliation("v_operations_validation", operations_checks()),
        statuses("v_database_validation", database_checks(manual_rows)),
        statuses("v_analytics_model_validation", model_checks()),
        statuses("v_customer_analytics_validation", customer_checks()),
    ]
