"""Check views: V01, V07, V15 (PASS/FAIL) and V24, V32 (expected/actual/difference).

A check frame is built from a few one-row aggregates (one per source frame,
each computing all of its checks in a single pass), cross-joined (1 x 1) and
unpivoted into one row per check. Nothing is collected to the driver.

The reference hard-codes golden counts of its own dataset (e.g. 99,441
orders). Here every such constant is re-aimed at an independent count over the
base tables (orders, items, reviews ...), so each check still compares the
model with its source on any data; ``expected`` overrides restore constants.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.exprs import count_if, is_completed

NUM = "decimal(38,2)"


def _one_row_frames(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.crossJoin(b), parts)


def status_checks(one: DataFrame, checks: list[tuple[str, str, str]]) -> DataFrame:
    """(check_name, actual_col, expected_col) -> check_name, actual, expected, status."""
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("check_name"), F.col(a).cast(NUM).alias("actual_value"), F.col(e).cast(NUM).alias("expected_value"))
                for n, a, e in checks
            ]
        )
    )
    out = one.select(rows.alias("r")).select("r.*")
    return out.withColumn("status", F.when(F.col("actual_value") == F.col("expected_value"), "PASS").otherwise("FAIL"))


def diff_checks(one: DataFrame, checks: list[tuple[str, str, str, Column]]) -> DataFrame:
    """(metric_name, expected_col, actual_col, passed) -> metric, expected, actual, difference, passed."""
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("metric_name"),
                    F.col(e).cast(NUM).alias("expected_value"),
                    F.col(a).cast(NUM).alias("actual_value"),
                    (F.col(a) - F.col(e)).cast(NUM).alias("difference"),
                    p.alias("passed"),
                )
                for n, e, a, p in checks
            ]
        )
    )
    return one.select(rows.alias("r")).select("r.*")


def _n(df: DataFrame, alias: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(alias))


def _orphans(child: DataFrame, parent: DataFrame, ck: str, pk: str, alias: str) -> DataFrame:
    """Child rows whose key has no parent row (left anti join, then count)."""
    keys = parent.select(F.col(pk).alias("_k")).distinct()
    return _n(child.join(keys, child[ck] == keys["_k"], "left_anti"), alias)


def database_validation(clean: dict[str, DataFrame], raw: dict[str, DataFrame], manual_rows: int) -> DataFrame:
    """9 row counts, 7 orphan counts, 4 value rules (catalog counts not built)."""
    t = clean
    parts = []
    checks = []
    for name in ["category_translation", "customers", "geolocation", "order_items", "orders", "payments", "products", "reviews", "sellers"]:
        parts.append(_n(t[name], f"a_{name}"))
        checks.append((f"row_count_{name}", f"a_{name}", f"e_{name}"))
    # Expected row counts, independently from the raw layer.
    for name in ["customers", "order_items", "orders", "payments", "products", "reviews", "sellers"]:
        parts.append(_n(raw[name], f"e_{name}"))
    parts.append(_n(raw["category_translation"], "e_ct_raw"))
    geo_raw = raw["geolocation"]
    parts.append(
        geo_raw.where(F.col("geolocation_lat").between(-90, 90) & F.col("geolocation_lng").between(-180, 180))
        .agg(F.count_distinct("geolocation_zip_code_prefix").alias("e_geolocation"))
    )
    orphan_specs = [
        ("orphan_orders_customers", t["orders"], t["customers"], "customer_id", "customer_id"),
        ("orphan_items_orders", t["order_items"], t["orders"], "order_id", "order_id"),
        ("orphan_items_products", t["order_items"], t["products"], "product_id", "product_id"),
        ("orphan_items_sellers", t["order_items"], t["sellers"], "seller_id", "seller_id"),
        ("orphan_payments_orders", t["payments"], t["orders"], "order_id", "order_id"),
        ("orphan_reviews_orders", t["reviews"], t["orders"], "order_id", "order_id"),
        ("orphan_products_categories", t["products"], t["category_translation"], "product_category_name", "product_category_name"),
    ]
    for name, child, parent, ck, pk in orphan_specs:
        parts.append(_orphans(child, parent, ck, pk, f"a_{name}"))
        checks.append((name, f"a_{name}", "zero"))
    parts.append(t["payments"].agg(count_if(F.col("payment_installments") < 1).alias("a_invalid_payment_installments")))
    parts.append(
        t["products"].agg(
            count_if(F.col("product_weight_g") <= 0).alias("a_non_positive_product_weights"),
            count_if(F.col("product_category_name_english").isNull()).alias("a_missing_english_categories"),
        )
    )
    parts.append(
        t["geolocation"].agg(
            count_if(~F.col("geolocation_lat").between(-90, 90) | ~F.col("geolocation_lng").between(-180, 180)).alias(
                "a_invalid_geolocation_coordinates"
            )
        )
    )
    for name in ["invalid_payment_installments", "non_positive_product_weights", "missing_english_categories", "invalid_geolocation_coordinates"]:
        checks.append((name, f"a_{name}", "zero"))
    one = _one_row_frames(parts).withColumn("zero", F.lit(0))
    # translation rows after the repair = raw rows + the manual rows
    one = one.withColumn("e_category_translation", F.col("e_ct_raw") + F.lit(manual_rows))
    return status_checks(one, checks)


def model_validation(
    clean: dict[str, DataFrame], order_summary: DataFrame, order_item_detail: DataFrame, aggs: dict[str, DataFrame]
) -> DataFrame:
    """22 checks of counts, uniqueness, reconciliation and flag consistency."""
    os, d = order_summary, order_item_detail
    items, pays, revs, orders = clean["order_items"], clean["payments"], clean["reviews"], clean["orders"]
    parts = [
        os.agg(
            F.count(F.lit(1)).alias("os_n"),
            F.count_distinct("order_id").alias("os_u"),
            F.sum("item_count").alias("os_items"),
            F.sum("review_record_count").alias("os_reviews"),
            count_if(F.col("customer_unique_id").isNull()).alias("os_missing_cust"),
            count_if(F.col("is_valid_delivery_record") & (F.col("delivery_days") < 0)).alias("os_bad_days"),
            count_if(
                F.col("delivery_delay_days").isNotNull() & ~F.col("is_late_delivery").eqNullSafe(F.col("delivery_delay_days") > 0)
            ).alias("os_flag_mismatch"),
            count_if(~F.col("has_item_record")).alias("os_no_items"),
            count_if(~F.col("has_payment_record")).alias("os_no_pay"),
            count_if(~F.col("has_review_record")).alias("os_no_rev"),
        ),
        d.agg(
            F.count(F.lit(1)).alias("d_n"),
            F.count_distinct(F.struct("order_id", "order_item_id")).alias("d_u"),
            F.sum("gross_item_value").alias("d_gross"),
            count_if(F.col("product_category_name_english").isNull()).alias("d_missing_cat"),
            count_if(F.col("seller_state").isNull()).alias("d_missing_seller"),
        ),
        aggs["items"].agg(
            F.count(F.lit(1)).alias("ia_n"),
            F.sum("item_price_total").alias("ia_price"),
            F.sum("freight_total").alias("ia_freight"),
            F.sum("gross_item_value").alias("ia_gross"),
        ),
        aggs["payments"].agg(F.count(F.lit(1)).alias("pa_n"), F.sum("payment_value_total").alias("pa_value")),
        aggs["reviews"].agg(F.count(F.lit(1)).alias("ra_n")),
        # Independent expectations from the base tables.
        orders.agg(F.count(F.lit(1)).alias("e_orders")),
        items.agg(
            F.count(F.lit(1)).alias("e_items"),
            F.count_distinct("order_id").alias("e_item_orders"),
            F.sum("price").alias("e_price"),
            F.sum("freight_value").alias("e_freight"),
            F.sum(F.col("price") + F.col("freight_value")).alias("e_gross"),
        ),
        pays.agg(F.count_distinct("order_id").alias("e_pay_orders"), F.sum("payment_value").alias("e_pay")),
        revs.agg(F.count(F.lit(1)).alias("e_reviews"), F.count_distinct("order_id").alias("e_rev_orders")),
        _n(orders.join(items.select("order_id").distinct(), "order_id", "left_anti"), "e_no_items"),
        _n(orders.join(pays.select("order_id").distinct(), "order_id", "left_anti"), "e_no_pay"),
        _n(orders.join(revs.select("order_id").distinct(), "order_id", "left_anti"), "e_no_rev"),
    ]
    one = _one_row_frames(parts).withColumn("zero", F.lit(0))
    checks = [
        ("order_summary_row_count", "os_n", "e_orders"),
        ("order_summary_unique_orders", "os_u", "e_orders"),
        ("item_detail_row_count", "d_n", "e_items"),
        ("item_detail_unique_items", "d_u", "e_items"),
        ("items_aggregation_row_count", "ia_n", "e_item_orders"),
        ("payments_aggregation_row_count", "pa_n", "e_pay_orders"),
        ("reviews_aggregation_row_count", "ra_n", "e_rev_orders"),
        ("order_summary_item_count_total", "os_items", "e_items"),
        ("order_summary_review_count_total", "os_reviews", "e_reviews"),
        ("item_price_total_reconciliation", "ia_price", "e_price"),
        ("freight_total_reconciliation", "ia_freight", "e_freight"),
        ("gross_item_total_reconciliation", "ia_gross", "e_gross"),
        ("payment_total_reconciliation", "pa_value", "e_pay"),
        ("item_detail_gross_reconciliation", "d_gross", "e_gross"),
        ("missing_customer_unique_id", "os_missing_cust", "zero"),
        ("missing_item_product_category", "d_missing_cat", "zero"),
        ("missing_item_seller", "d_missing_seller", "zero"),
        ("invalid_valid_delivery_days", "os_bad_days", "zero"),
        ("late_delivery_flag_mismatch", "os_flag_mismatch", "zero"),
        ("orders_without_items", "os_no_items", "e_no_items"),
        ("orders_without_payments", "os_no_pay", "e_no_pay"),
        ("orders_without_reviews", "os_no_rev", "e_no_rev"),
    ]
    return status_checks(one, checks)


def customer_validation(
    clean: dict[str, DataFrame],
    order_summary: DataFrame,
    summary: DataFrame,
    activity: DataFrame,
    metrics: DataFrame,
    retention: DataFrame,
    rfm: DataFrame,
    segments: DataFrame,
) -> DataFrame:
    """20 checks over V08-V14."""
    cust = clean["customers"].join(clean["orders"].select("customer_id"), "customer_id", "inner")
    per_person = cust.groupBy("customer_unique_id").agg(F.count(F.lit(1)).alias("n"))
    done = order_summary.where((F.col("order_status") == "delivered") & F.col("has_payment_record"))
    bad_scores = ((F.col("completed_order_count") > 0) & (
        ~F.col("recency_score").between(1, 5) | ~F.col("frequency_score").between(1, 5) | ~F.col("monetary_score").between(1, 5)
    )) | ((F.col("completed_order_count") == 0) & (
        (F.col("recency_score") != 0) | (F.col("frequency_score") != 0) | (F.col("monetary_score") != 0)
    ))
    parts = [
        summary.agg(
            F.count(F.lit(1)).alias("cs_n"),
            F.count_distinct("customer_unique_id").alias("cs_u"),
            F.sum("order_count").alias("cs_orders"),
            count_if(F.col("is_repeat_customer")).alias("cs_repeat"),
            count_if(~F.col("is_repeat_customer")).alias("cs_once"),
        ),
        metrics.agg(
            F.sum("new_customer_count").alias("m_new"),
            F.sum("order_count").alias("m_orders"),
            count_if(F.col("active_customer_count") != F.col("new_customer_count") + F.col("returning_customer_count")).alias("m_bal"),
        ),
        activity.agg(count_if(F.col("months_since_first_order") < 0).alias("a_neg")),
        retention.agg(
            F.sum(F.when(F.col("months_since_first_order") == 0, F.col("active_customer_count"))).alias("r_m0"),
            count_if((F.col("months_since_first_order") == 0) & (F.col("retention_rate_pct") != 100)).alias("r_bad0"),
            count_if((F.col("retention_rate_pct") < 0) | (F.col("retention_rate_pct") > 100)).alias("r_bad"),
        ),
        rfm.agg(
            F.count(F.lit(1)).alias("rfm_n"),
            F.count_distinct("customer_unique_id").alias("rfm_u"),
            count_if(F.col("customer_segment").isNull()).alias("rfm_unseg"),
            count_if(bad_scores).alias("rfm_bad"),
            F.sum("completed_order_count").alias("rfm_orders"),
            F.sum("monetary_value").alias("rfm_value"),
            count_if(F.col("completed_order_count") == 0).alias("rfm_none"),
        ),
        segments.agg(F.sum("customer_count").alias("seg_n")),
        # Independent expectations from the base tables / order model.
        per_person.agg(
            F.count(F.lit(1)).alias("e_customers"),
            F.sum("n").alias("e_orders"),
            count_if(F.col("n") > 1).alias("e_repeat"),
            count_if(F.col("n") == 1).alias("e_once"),
        ),
        done.agg(
            F.count(F.lit(1)).alias("e_done_orders"),
            F.sum("payment_value_total").alias("e_done_value"),
            F.count_distinct("customer_unique_id").alias("e_buyers"),
        ),
    ]
    one = _one_row_frames(parts).withColumn("zero", F.lit(0)).withColumn("e_no_buyers", F.col("e_customers") - F.col("e_buyers"))
    checks = [
        ("customer_summary_row_count", "cs_n", "e_customers"),
        ("customer_summary_unique_customers", "cs_u", "e_customers"),
        ("customer_summary_order_reconciliation", "cs_orders", "e_orders"),
        ("repeat_customer_count", "cs_repeat", "e_repeat"),
        ("one_time_customer_count", "cs_once", "e_once"),
        ("monthly_new_customer_reconciliation", "m_new", "e_customers"),
        ("monthly_order_reconciliation", "m_orders", "e_orders"),
        ("monthly_customer_balance_mismatch", "m_bal", "zero"),
        ("negative_months_since_first_order", "a_neg", "zero"),
        ("cohort_month_0_customer_reconciliation", "r_m0", "e_customers"),
        ("invalid_month_0_retention", "r_bad0", "zero"),
        ("invalid_retention_rate", "r_bad", "zero"),
        ("rfm_customer_row_count", "rfm_n", "e_customers"),
        ("rfm_unique_customer_count", "rfm_u", "e_customers"),
        ("rfm_unsegmented_customers", "rfm_unseg", "zero"),
        ("rfm_invalid_scores", "rfm_bad", "zero"),
        ("rfm_completed_order_reconciliation", "rfm_orders", "e_done_orders"),
        ("rfm_payment_value_reconciliation", "rfm_value", "e_done_value"),
        ("segment_customer_reconciliation", "seg_n", "e_customers"),
        ("customers_without_completed_purchase", "rfm_none", "e_no_buyers"),
    ]
    return status_checks(one, checks)


def sales_validation(order_summary: DataFrame, monthly: DataFrame, categories: DataFrame, products: DataFrame) -> DataFrame:
    """8 reconciliation / grain checks; money tolerance |diff| < 0.01."""
    src = order_summary.where(is_completed()).agg(
        F.count(F.lit(1)).alias("s_n"),
        F.round(F.sum("payment_value_total"), 2).alias("s_pay"),
        F.round(F.sum(F.coalesce("item_price_total", F.lit(0))), 2).alias("s_price"),
        F.round(F.sum(F.coalesce("freight_total", F.lit(0))), 2).alias("s_freight"),
    )
    parts = [
        src,
        monthly.agg(F.sum("order_count").alias("m_n"), F.round(F.sum("payment_value_total"), 2).alias("m_pay")),
        categories.agg(
            F.round(F.sum("item_price_total"), 2).alias("c_price"),
            F.round(F.sum("freight_total"), 2).alias("c_freight"),
            (F.count(F.lit(1)) - F.count_distinct("product_category_name_english")).alias("c_dup"),
        ),
        products.agg(
            F.round(F.sum("item_price_total"), 2).alias("p_price"),
            F.round(F.sum("freight_total"), 2).alias("p_freight"),
            (F.count(F.lit(1)) - F.count_distinct("product_id")).alias("p_dup"),
        ),
    ]
    one = _one_row_frames(parts).withColumn("zero", F.lit(0))

    def tol(a: str, e: str) -> Column:
        return F.abs(F.col(a) - F.col(e)) < 0.01

    checks = [
        ("monthly_order_count", "s_n", "m_n", F.col("m_n") == F.col("s_n")),
        ("monthly_payment_value", "s_pay", "m_pay", tol("m_pay", "s_pay")),
        ("category_item_price", "s_price", "c_price", tol("c_price", "s_price")),
        ("category_freight", "s_freight", "c_freight", tol("c_freight", "s_freight")),
        ("product_item_price", "s_price", "p_price", tol("p_price", "s_price")),
        ("product_freight", "s_freight", "p_freight", tol("p_freight", "s_freight")),
        ("category_duplicate_grains", "zero", "c_dup", F.col("c_dup") == 0),
        ("product_duplicate_grains", "zero", "p_dup", F.col("p_dup") == 0),
    ]
    return diff_checks(one, checks)


def operations_validation(
    order_summary: DataFrame,
    monthly_delivery_df: DataFrame,
    state_df: DataFrame,
    kpis: DataFrame,
    impact: DataFrame,
    sellers: DataFrame,
    seller_orders: DataFrame,
) -> DataFrame:
    """6 checks over V25-V30."""
    parts = [
        order_summary.where(is_completed()).agg(
            F.count(F.lit(1)).alias("s_n"), count_if(F.col("is_valid_delivery_record")).alias("s_nv")
        ),
        monthly_delivery_df.agg(F.sum("completed_order_count").alias("m")),
        state_df.agg(F.sum("completed_order_count").alias("st")),
        kpis.select(F.col("completed_order_count").alias("k")),
        impact.agg(F.sum("order_count").alias("d")),
        sellers.agg((F.count(F.lit(1)) - F.count_distinct("seller_id")).alias("sdup")),
        # grouped by the order, in whose buckets the rows lie
        seller_orders.groupBy("order_id", "seller_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("sodup")),
    ]
    one = _one_row_frames(parts).withColumn("zero", F.lit(0))
    checks = [
        ("monthly_completed_orders", "s_n", "m", F.col("m") == F.col("s_n")),
        ("state_completed_orders", "s_n", "st", F.col("st") == F.col("s_n")),
        ("overall_completed_orders", "s_n", "k", F.col("k") == F.col("s_n")),
        ("delivery_status_orders", "s_nv", "d", F.col("d") == F.col("s_nv")),
        ("seller_duplicate_grains", "zero", "sdup", F.col("sdup") == 0),
        ("seller_order_duplicate_grains", "zero", "sodup", F.col("sodup") == 0),
    ]
    return diff_checks(one, checks)


def model_profile(order_summary: DataFrame) -> DataFrame:
    """Q11: ad-hoc profile of the order model (orders lacking children, reconstructed counts)."""
    return order_summary.agg(
        F.count(F.lit(1)).alias("order_count"),
        count_if(~F.col("has_item_record")).alias("orders_without_items"),
        count_if(~F.col("has_payment_record")).alias("orders_without_payments"),
        count_if(~F.col("has_review_record")).alias("orders_without_reviews"),
        F.sum("item_count").alias("reconstructed_item_count"),
        F.sum("review_record_count").alias("reconstructed_review_count"),
    )


def share_checks(categories: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """Q12: revenue shares must add up to (about) 100 % per view."""
    shares = [("category_performance", categories, "item_revenue_share_pct"), ("product_performance", products, "item_revenue_share_pct"), ("seller_performance", sellers, "seller_revenue_share_pct")]
    # one type before the union: a wider one would cost another view's digits
    parts = [df.agg(F.sum(c).cast("decimal(18,4)").alias("total_share_pct")).select(F.lit(view).alias("view_name"), "total_share_pct") for view, df, c in shares]
    return reduce(DataFrame.unionByName, parts)
