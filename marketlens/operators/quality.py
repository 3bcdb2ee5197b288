"""Data-quality profiles and rule checks.

Every report is a handful of aggregations: one pass per table computing all
of that table's metrics, then unpivoted into report rows. Key and foreign-key
profiles use hash aggregation and anti joins, never collected sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.exprs import count_if, pct

# Fixed values that must equal the reference's.
NUMERIC_COLUMNS = [
    ("order_items", "price"),
    ("order_items", "freight_value"),
    ("payments", "payment_value"),
    ("payments", "payment_installments"),
    ("reviews", "review_score"),
    ("products", "product_weight_g"),
    ("products", "product_length_cm"),
    ("products", "product_height_cm"),
    ("products", "product_width_cm"),
]
BUSINESS_RULES = [
    ("negative_item_price", "order_items", "price < 0"),
    ("negative_freight_value", "order_items", "freight_value < 0"),
    ("negative_payment_value", "payments", "payment_value < 0"),
    ("payment_installments_less_than_one", "payments", "payment_installments < 1"),
    ("review_score_outside_1_to_5", "reviews", "review_score < 1 OR review_score > 5"),
    ("nonpositive_product_weight", "products", "product_weight_g <= 0"),
    ("nonpositive_product_length", "products", "product_length_cm <= 0"),
    ("nonpositive_product_height", "products", "product_height_cm <= 0"),
    ("nonpositive_product_width", "products", "product_width_cm <= 0"),
]
FINAL_KEYS = {
    "customers": ["customer_id"],
    "orders": ["order_id"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "category_translation": ["product_category_name"],
    "order_items": ["order_id", "order_item_id"],
    "payments": ["order_id", "payment_sequential"],
    "reviews": ["review_id", "order_id"],
    "geolocation": ["geolocation_zip_code_prefix"],
}
CANDIDATE_KEYS = [
    ("customers", ["customer_id"], "Expected primary key"),
    ("customers", ["customer_unique_id"], "Customer identity; expected to repeat"),
    ("orders", ["order_id"], "Expected primary key"),
    ("products", ["product_id"], "Expected primary key"),
    ("sellers", ["seller_id"], "Expected primary key"),
    ("category_translation", ["product_category_name"], "Expected primary key"),
    ("order_items", ["order_id", "order_item_id"], "Expected composite primary key"),
    ("payments", ["order_id", "payment_sequential"], "Expected composite primary key"),
    ("reviews", ["review_id"], "Candidate key requiring validation"),
    ("reviews", ["review_id", "order_id"], "Candidate composite key"),
    ("geolocation", ["geolocation_zip_code_prefix"], "Expected to repeat; not a primary key"),
]
FOREIGN_KEYS = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("reviews", "order_id", "orders", "order_id"),
    ("products", "product_category_name", "category_translation", "product_category_name"),
]
TREATMENTS = [
    ("payments", "payment_installments_less_than_one", "Changed installment count from 0 to 1"),
    ("products", "nonpositive_product_weight", "Changed zero weight to missing"),
    ("orders", "timestamp_or_status_anomalies", "Preserved records and added quality flags"),
]
# Clean-layer CHECK and NOT NULL rules (table DDL re-aimed as row expectations).
#: Columns that may not be NULL in the clean layer.
NOT_NULL = {
    "customers": ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"],
    "geolocation": [
        "geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_city", "geolocation_state", "geolocation_observation_count",
    ],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value"],
    "orders": ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_estimated_delivery_date", "has_timestamp_anomaly", "has_status_date_mismatch", "is_valid_delivery_record"],
    "payments": ["order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"],
    "products": ["product_id", "product_category_name", "product_category_name_english"],
    "reviews": ["review_id", "order_id", "review_score", "review_creation_date", "review_answer_timestamp"],
    "sellers": ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"],
    "category_translation": ["product_category_name", "product_category_name_english"],
}
CONSTRAINTS = [
    ("customers", "customer_zip_code_prefix_format", "NOT (customer_zip_code_prefix RLIKE '^[0-9]{5}$')"),
    ("customers", "customer_state_length", "length(customer_state) > 2"),
    ("geolocation", "geolocation_zip_code_prefix_format", "NOT (geolocation_zip_code_prefix RLIKE '^[0-9]{5}$')"),
    ("geolocation", "geolocation_lat_range", "geolocation_lat NOT BETWEEN -90 AND 90"),
    ("geolocation", "geolocation_lng_range", "geolocation_lng NOT BETWEEN -180 AND 180"),
    ("geolocation", "geolocation_observation_count_positive", "geolocation_observation_count <= 0"),
    ("order_items", "price_non_negative", "price < 0"),
    ("order_items", "freight_value_non_negative", "freight_value < 0"),
    ("payments", "payment_installments_at_least_one", "payment_installments < 1"),
    ("payments", "payment_value_non_negative", "payment_value < 0"),
    ("products", "product_weight_g_null_or_positive", "product_weight_g IS NOT NULL AND product_weight_g <= 0"),
    ("reviews", "review_score_between_1_and_5", "review_score NOT BETWEEN 1 AND 5"),
    ("sellers", "seller_zip_code_prefix_format", "NOT (seller_zip_code_prefix RLIKE '^[0-9]{5}$')"),
    ("sellers", "seller_state_length", "length(seller_state) > 2"),
    *((table, f"{column}_not_null", f"{column} IS NULL") for table, columns in NOT_NULL.items() for column in columns),
]


def _unpivot(one: DataFrame, rows: list[list[Column]]) -> DataFrame:
    return one.select(F.explode(F.array(*[F.struct(*r) for r in rows])).alias("r")).select("r.*")


def numeric_profile(raw: dict[str, DataFrame]) -> DataFrame:
    """Missing, negative, zero, min and max per numeric column (before treatment)."""
    parts = []
    by_table: dict[str, list[str]] = {}
    for t, c in NUMERIC_COLUMNS:
        by_table.setdefault(t, []).append(c)
    for t, cols in by_table.items():
        aggs = []
        for c in cols:
            x = F.col(c).cast("double")
            aggs += [
                count_if(x.isNull()).alias(f"{c}__m"),
                count_if(x < 0).alias(f"{c}__n"),
                count_if(x == 0).alias(f"{c}__z"),
                F.min(x).alias(f"{c}__lo"),
                F.max(x).alias(f"{c}__hi"),
            ]
        one = raw[t].agg(*aggs)
        parts.append(
            _unpivot(
                one,
                [
                    [
                        F.lit(t).alias("table_name"),
                        F.lit(c).alias("column_name"),
                        F.col(f"{c}__m").cast("long").alias("missing_values"),
                        F.col(f"{c}__n").cast("long").alias("negative_values"),
                        F.col(f"{c}__z").cast("long").alias("zero_values"),
                        F.col(f"{c}__lo").alias("minimum_value"),
                        F.col(f"{c}__hi").alias("maximum_value"),
                    ]
                    for c in cols
                ],
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _rule_counts(tables: dict[str, DataFrame], rules: list[tuple[str, str, str]], name_col: str, count_col: str, with_table: bool) -> DataFrame:
    parts = []
    by_table: dict[str, list[tuple[str, str]]] = {}
    for name, t, cond in rules:
        by_table.setdefault(t, []).append((name, cond))
    for t, rs in by_table.items():
        one = tables[t].agg(*[count_if(F.expr(cond)).alias(f"_{i}") for i, (_, cond) in enumerate(rs)])
        cols = [[F.lit(n).alias(name_col), F.col(f"_{i}").cast("long").alias(count_col)] for i, (n, _) in enumerate(rs)]
        if with_table:
            cols = [[F.lit(t).alias("table_name"), *c] for c in cols]
        parts.append(_unpivot(one, cols))
    return reduce(DataFrame.unionByName, parts)


def business_rules(raw: dict[str, DataFrame]) -> DataFrame:
    """Rows violating each business rule (before treatment)."""
    return _rule_counts(raw, BUSINESS_RULES, "check_name", "affected_rows", False)


def constraint_checks(clean: dict[str, DataFrame]) -> DataFrame:
    """Q09/Q10: CHECK / NOT NULL / length rules of the clean layer as violation counts."""
    rules = [(n, t, c) for t, n, c in CONSTRAINTS]
    return _rule_counts(clean, rules, "rule_name", "violating_rows", True)


def invalid_rows(raw: dict[str, DataFrame]) -> DataFrame:
    """The rows the numeric treatment will change (a quarantine frame)."""
    p = raw["payments"].where(F.col("payment_installments") < 1).select(
        F.lit("payments").alias("table_name"),
        F.lit("payment_installments_less_than_one").alias("issue"),
        F.concat_ws(" + ", "order_id", F.col("payment_sequential").cast("string")).alias("record_key"),
        F.col("payment_installments").cast("double").alias("value"),
    )
    w = raw["products"].where(F.col("product_weight_g") <= 0).select(
        F.lit("products").alias("table_name"),
        F.lit("nonpositive_product_weight").alias("issue"),
        F.col("product_id").alias("record_key"),
        F.col("product_weight_g").cast("double").alias("value"),
    )
    return p.unionByName(w)


def treatment_summary(raw: dict[str, DataFrame], orders_flagged: DataFrame) -> DataFrame:
    """Affected rows per treatment."""
    a = raw["payments"].agg(count_if(F.col("payment_installments") < 1).alias("v"))
    b = raw["products"].agg(count_if(F.col("product_weight_g").isNotNull() & (F.col("product_weight_g") <= 0)).alias("v"))
    c = orders_flagged.agg(count_if(F.col("has_timestamp_anomaly") | F.col("has_status_date_mismatch")).alias("v"))
    parts = []
    for (t, issue, treat), df in zip(TREATMENTS, (a, b, c)):
        parts.append(
            df.select(
                F.lit(t).alias("table_name"), F.lit(issue).alias("issue"), F.col("v").cast("long").alias("affected_rows"), F.lit(treat).alias("treatment")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def status_counts(orders: DataFrame) -> DataFrame:
    """Orders per status with share of all orders (the total is one row)."""
    g = orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("order_count"))
    total = F.broadcast(orders.agg(F.count(F.lit(1)).alias("_n")))
    return g.crossJoin(total).select("order_status", "order_count", pct("order_count", "_n").alias("order_pct"))


def _dup_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows in key groups of size > 1 (pandas ``duplicated(keep=False)``), plus group count."""
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("dup"),
        F.count(F.lit(1)).alias("groups"),
    )


def final_key_checks(clean: dict[str, DataFrame]) -> DataFrame:
    """Null and duplicate key rows per clean table."""
    parts = []
    for t, keys in FINAL_KEYS.items():
        df = clean[t]
        nulls = df.agg(count_if(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).alias("nulls"))
        one = nulls.crossJoin(_dup_rows(df, keys))
        parts.append(
            one.select(
                F.lit(t).alias("table_name"),
                F.lit(" + ".join(keys)).alias("key_columns"),
                F.col("nulls").cast("long").alias("null_key_rows"),
                F.col("dup").cast("long").alias("duplicate_key_rows"),
                ((F.col("nulls") == 0) & (F.col("dup") == 0)).alias("key_valid"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def key_checks(raw: dict[str, DataFrame]) -> DataFrame:
    """Q02: candidate-key profile of the raw tables."""
    parts = []
    for t, keys, expectation in CANDIDATE_KEYS:
        df = raw[t]
        any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        base = df.agg(F.count(F.lit(1)).alias("total"), count_if(any_null).alias("nulls"))
        # unique combinations of fully non-null keys (pandas drops NaN keys)
        g = df.where(~any_null).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        d = g.agg(F.count(F.lit(1)).alias("uniq"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("dup"))
        parts.append(
            base.crossJoin(d).select(
                F.lit(t).alias("table_name"),
                F.lit(" + ".join(keys)).alias("candidate_key"),
                F.col("total").cast("long").alias("total_rows"),
                F.col("uniq").cast("long").alias("unique_combinations"),
                F.col("nulls").cast("long").alias("null_key_rows"),
                F.col("dup").cast("long").alias("duplicate_key_rows"),
                ((F.col("nulls") == 0) & (F.col("dup") == 0)).alias("is_valid_key"),
                F.lit(expectation).alias("expectation"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def foreign_key_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """Q03: child rows, NULL children, orphans (left anti join), coverage of non-null children."""
    parts = []
    for child, ck, parent, pk in FOREIGN_KEYS:
        c = tables[child].select(F.col(ck).alias("_k"))
        keys = tables[parent].select(F.col(pk).alias("_k")).distinct()
        orphans = c.where(F.col("_k").isNotNull()).join(keys, "_k", "left_anti")
        a = c.agg(F.count(F.lit(1)).alias("rows"), count_if(F.col("_k").isNull()).alias("nulls"))
        o = orphans.agg(F.count(F.lit(1)).alias("orph"), F.count_distinct("_k").alias("orph_u"))
        parts.append(
            a.crossJoin(o).select(
                F.lit(f"{child}.{ck} -> {parent}.{pk}").alias("relationship"),
                F.col("rows").cast("long").alias("child_rows"),
                F.col("nulls").cast("long").alias("child_null_rows"),
                F.col("orph").cast("long").alias("orphan_rows"),
                F.col("orph_u").cast("long").alias("orphan_unique_values"),
                pct(F.col("rows") - F.col("nulls") - F.col("orph"), F.col("rows") - F.col("nulls")).alias("coverage_pct"),
                (F.col("orph") == 0).alias("relationship_valid"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def check_totals(checks: DataFrame) -> DataFrame:
    """Number of checks per status."""
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("check_count"))
