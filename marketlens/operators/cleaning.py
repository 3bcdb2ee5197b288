"""Cleaning job (raw -> clean layer) and its reports.

Every step is a column expression or one aggregation; nothing is collected.
The order of steps follows the reference: dates, ZIP codes, text, category
repair, geolocation, numeric treatment, order quality flags.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marketlens.functions.exprs import count_if, pct
from marketlens.operators.medians import group_medians, land_rows
from marketlens.sources.schemas import CLEAN_COLUMNS, conform

# Fixed values that must equal the reference's.
DATE_COLUMNS = {
    "orders": [
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    ],
    "order_items": ["shipping_limit_date"],
    "reviews": ["review_creation_date", "review_answer_timestamp"],
}
ZIP_COLUMNS = {
    "customers": "customer_zip_code_prefix",
    "sellers": "seller_zip_code_prefix",
    "geolocation": "geolocation_zip_code_prefix",
}
MANUAL_TRANSLATIONS = [
    ("portateis_cozinha_e_preparadores_de_alimentos", "portable_kitchen_and_food_preparation_appliances"),
    ("pc_gamer", "gaming_pc"),
    ("unknown", "unknown"),
]
UNKNOWN_CATEGORY = "unknown"
TIMESTAMP_RULES = [
    "approval_before_purchase",
    "carrier_before_purchase",
    "carrier_before_approval",
    "delivery_before_carrier",
    "delivery_before_purchase",
    "estimated_before_purchase",
]
STATUS_RULES = ["delivered_status_missing_delivery_date", "non_delivered_status_with_delivery_date"]

# Text columns are stripped of all Unicode whitespace at both ends (str.strip()): the characters of the pattern
# ``(?U)\s``, trimmed in the bytes of the text instead of matched at each of its places.
WHITESPACE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


# ---------------------------------------------------------------- C1 dates
def parse_timestamp(c: str | Column) -> Column:
    """``to_datetime(format='%Y-%m-%d %H:%M:%S', errors='coerce')``: the whole text in this form
    (parts of one digit allowed, no padding, fraction, zone or other separator), else NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\z"), c.try_cast("timestamp_ntz"))


def convert_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: parse_timestamp(c) for c in columns})


def date_conversion_report(raw: dict[str, DataFrame]) -> DataFrame:
    """Per date column missing before/after, parse failures, min, max."""
    parts = []
    for table, cols in DATE_COLUMNS.items():
        df = raw[table]
        aggs = []
        for c in cols:
            parsed = parse_timestamp(c)
            aggs += [
                count_if(F.col(c).isNull()).alias(f"{c}__mb"),
                count_if(parsed.isNull()).alias(f"{c}__ma"),
                count_if(F.col(c).isNotNull() & parsed.isNull()).alias(f"{c}__pf"),
                F.min(parsed).alias(f"{c}__min"),
                F.max(parsed).alias(f"{c}__max"),
            ]
        one = df.agg(*aggs)  # one pass per table
        for c in cols:
            parts.append(
                one.select(
                    F.lit(table).alias("table_name"),
                    F.lit(c).alias("column_name"),
                    F.col(f"{c}__mb").cast("long").alias("missing_before"),
                    F.col(f"{c}__ma").cast("long").alias("missing_after"),
                    F.col(f"{c}__pf").cast("long").alias("parse_failures"),
                    F.col(f"{c}__min").alias("minimum_date"),
                    F.col(f"{c}__max").alias("maximum_date"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- C2 ZIP
def whole_number(c: str | Column) -> Column:
    """``to_numeric(errors='coerce')`` for whole numbers in any numeric form ('1234.0', ' 77 ', '1e3'), else NULL."""
    t = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    n = F.when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"), t.try_cast("double"))
    return F.when(n == F.floor(n), n.try_cast("long"))


def standardize_zip(c: str | Column) -> Column:
    """``zfill(5)`` of a whole number: zeros after the sign up to five characters; longer values are kept."""
    n = whole_number(c)
    digits = F.abs(n).cast("string")
    width = F.when(n < 0, F.lit(4)).otherwise(F.lit(5))
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, F.lit("0"))).otherwise(digits)
    return F.when(n < 0, F.concat(F.lit("-"), padded)).otherwise(padded)


def zip_report(raw: dict[str, DataFrame]) -> DataFrame:
    """Missing, invalid parse and invalid length per ZIP column."""
    parts = []
    for table, c in ZIP_COLUMNS.items():
        z = standardize_zip(c)
        parts.append(
            raw[table].agg(
                F.lit(table).alias("table_name"),
                F.lit(c).alias("column_name"),
                count_if(z.isNull()).cast("long").alias("missing_values"),
                count_if(F.col(c).isNotNull() & whole_number(c).isNull()).cast("long").alias("invalid_parse_values"),
                count_if(z.isNotNull() & (F.length(z) != 5)).cast("long").alias("invalid_length_values"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- C3 text
def strip_text(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(_stripped(c), F.lit(""))


def _stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def text_columns(df: DataFrame) -> list[str]:
    """Every string-typed column of a table."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def standardize_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: strip_text(c) for c in text_columns(df)})


def text_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Per text column missing before, blanks removed, missing after, and the type it has then.

    ``tables`` are the frames as they enter the text step (dates and ZIPs done).
    """
    parts = []
    for table, df in tables.items():
        cols = text_columns(df)
        if not cols:
            continue
        after = standardize_text(df).schema
        aggs = []
        for c in cols:
            stripped = _stripped(F.col(c))
            aggs += [
                count_if(F.col(c).isNull()).alias(f"{c}__mb"),
                count_if(stripped == "").alias(f"{c}__bl"),
            ]
        one = df.agg(*aggs)
        for c in cols:
            parts.append(
                one.select(
                    F.lit(table).alias("table_name"),
                    F.lit(c).alias("column_name"),
                    F.col(f"{c}__mb").cast("long").alias("missing_before"),
                    F.col(f"{c}__bl").cast("long").alias("blank_strings_removed"),
                    (F.col(f"{c}__mb") + F.col(f"{c}__bl")).cast("long").alias("missing_after"),
                    F.lit(after[c].dataType.simpleString()).alias("data_type_after"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- C5 categories
def repair_translation(translation: DataFrame, manual: list[tuple[str, str]] | None = None) -> DataFrame:
    spark = translation.sparkSession
    manual = MANUAL_TRANSLATIONS if manual is None else manual
    extra = spark.createDataFrame(manual, "product_category_name string, product_category_name_english string")
    return translation.unionByName(extra)


def unique_translation(translation: DataFrame) -> DataFrame:
    """The lookup with at most one row per category, checked when it is used (``validate='many_to_one'``): a
    category with several rows raises in the task that meets it, before any product is joined."""
    rows = translation.groupBy("product_category_name").agg(F.count(F.lit(1)).alias("_n"), F.first("product_category_name_english").alias("product_category_name_english"))
    message = F.concat(F.lit("duplicate translation of category "), F.coalesce("product_category_name", F.lit("NULL")))
    checked = F.when(F.col("_n") > 1, F.raise_error(message).cast("string")).otherwise(F.col("product_category_name_english"))
    return rows.select("product_category_name", checked.alias("product_category_name_english"))


def repair_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """NULL category -> 'unknown', then a validated many-to-one lookup of the English name.

    The translation table is one row per category (a dimension whose size is
    the number of categories, not the number of products); the join is left so
    products are never dropped.
    """
    p = products.withColumn("product_category_name", F.coalesce(F.col("product_category_name"), F.lit(UNKNOWN_CATEGORY)))
    return p.join(unique_translation(translation), "product_category_name", "left").select(*products.columns, "product_category_name_english")


def category_report(raw_products: DataFrame, raw_translation: DataFrame, manual: list[tuple[str, str]] | None = None) -> DataFrame:
    """Eight metrics of the category repair (metric, value)."""
    translation = repair_translation(raw_translation, manual)
    repaired = repair_products(raw_products, translation)
    known = raw_translation.select("product_category_name").distinct()
    untranslated = raw_products.where(F.col("product_category_name").isNotNull()).join(known, "product_category_name", "left_anti")
    tb = raw_translation.agg(F.count(F.lit(1)).alias("v"))
    ta = translation.agg(F.count(F.lit(1)).alias("v"))
    pb = raw_products.agg(count_if(F.col("product_category_name").isNull()).alias("m"), F.count(F.lit(1)).alias("n"))
    pa = repaired.agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col("product_category_name_english").isNull()).alias("miss"),
    )
    un = untranslated.agg(F.count(F.lit(1)).alias("v"))
    one = pb.crossJoin(pa.withColumnsRenamed({"n": "n_after"})).crossJoin(tb.withColumnRenamed("v", "tb")).crossJoin(
        ta.withColumnRenamed("v", "ta")
    ).crossJoin(un.withColumnRenamed("v", "un"))
    metrics = [
        ("missing_categories_before", "m"),
        ("untranslated_products_before", "un"),
        ("translation_rows_before", "tb"),
        ("translation_rows_after", "ta"),
        ("product_rows_before_merge", "n"),
        ("product_rows_after_merge", "n_after"),
        ("unmatched_products_after_merge", "miss"),
        ("missing_english_categories_after", "miss"),
    ]
    return one.select(
        F.explode(
            F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).cast("long").alias("value")) for name, c in metrics])
        ).alias("r")
    ).select("r.*")


def untranslated_categories(raw_products: DataFrame, raw_translation: DataFrame) -> DataFrame:
    """Q04: categories present on products but absent from the translation table."""
    known = raw_translation.select("product_category_name").distinct()
    return (
        raw_products.where(F.col("product_category_name").isNotNull())
        .join(known, "product_category_name", "left_anti")
        .groupBy("product_category_name")
        .agg(F.count(F.lit(1)).alias("product_rows"))
    )


# ---------------------------------------------------------------- C6/C7 geolocation
def valid_coordinates() -> Column:
    return F.col("geolocation_lat").between(-90, 90) & F.col("geolocation_lng").between(-180, 180)


def group_modes(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Most frequent non-NULL value of each column per key; ties -> smallest value (pandas mode + sort).

    Two hash aggregations with partial aggregation for all columns: counts of (key, column, value), then the best
    (count, value) of each column per key. No group's values are held in one buffer.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in values]))
    counts = df.select(key, cells.alias("x")).select(key, "x.c", "x.v").where(F.col("v").isNotNull()).groupBy(key, "c", "v").agg(F.count(F.lit(1)).alias("n"))
    best = lambda c: F.min_by("v", F.when(F.col("c") == c, F.struct((-F.col("n")).alias("n"), F.col("v").alias("v"))))
    return counts.groupBy(key).agg(*[best(c).alias(c) for c in values])


def group_median(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Exact interpolating median per key (pandas ``median``), hot-key safe."""
    return group_medians(df, key, {value: out})


def clean_geolocation(geo: DataFrame) -> DataFrame:
    """Exact dedup -> valid coordinates -> one row per ZIP (median, mode, size).

    The different rows are landed once; both medians, both modes and the size read them. Every per-ZIP aggregate
    shuffles on hash keys with partial aggregation, and none holds a ZIP's values in one buffer, so a ZIP with a
    third of all rows does not become one task.
    """
    k = "geolocation_zip_code_prefix"
    valid = land_rows(geo.dropDuplicates().where(valid_coordinates()), "geolocation")
    size = valid.groupBy(k).agg(F.count(F.lit(1)).cast("int").alias("geolocation_observation_count"))
    middle = group_medians(valid, k, {"geolocation_lat": "geolocation_lat", "geolocation_lng": "geolocation_lng"})
    modes = group_modes(valid, k, ["geolocation_city", "geolocation_state"])
    j = size.join(middle, k, "left").join(modes, k, "left")
    return j.select(
        k,
        F.round("geolocation_lat", 6).alias("geolocation_lat"),
        F.round("geolocation_lng", 6).alias("geolocation_lng"),
        "geolocation_city",
        "geolocation_state",
        "geolocation_observation_count",
    )


def geolocation_report(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """The raw table beside the landed clean one (metric, value)."""
    zip_code = "geolocation_zip_code_prefix"
    # copies are counted by hash-grouped rows, never sorted
    groups = raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("n"))
    inside = F.coalesce(valid_coordinates(), F.lit(False))
    a = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicate_rows"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("invalid_coordinate_rows"),
        F.count_distinct(zip_code).alias("unique_zip_codes_before"),
    )
    b = clean.agg(F.count(F.lit(1)).alias("clean_rows"), (F.count(F.lit(1)) - F.count_distinct(zip_code)).alias("duplicate_zip_codes_after"))
    metrics = [*a.columns, *b.columns]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value")) for n in metrics]))
    return a.crossJoin(b).select(rows.alias("r")).select("r.*")  # one row each


def zip_coverage(customers: DataFrame, sellers: DataFrame, geolocation: DataFrame) -> DataFrame:
    """ZIP coverage of customers and sellers by the clean geolocation; rows without a ZIP count in
    ``total_rows`` only."""
    zips = geolocation.select(F.col("geolocation_zip_code_prefix").alias("z")).distinct().withColumn("known", F.lit(True))
    parts = []
    for name, df, c in (("customers", customers, "customer_zip_code_prefix"), ("sellers", sellers, "seller_zip_code_prefix")):
        # one row per ZIP code before the join
        counts = df.groupBy(F.col(c).alias("z")).agg(F.count(F.lit(1)).alias("n"))
        missed = F.col("z").isNotNull() & F.col("known").isNull()
        with_zip = F.coalesce(F.sum(F.when(F.col("z").isNotNull(), F.col("n"))), F.lit(0))
        unmatched = F.coalesce(F.sum(F.when(missed, F.col("n"))), F.lit(0))
        parts.append(
            counts.join(zips, "z", "left").agg(
                F.lit(name).alias("table_name"),
                F.lit(c).alias("zip_column"),
                F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_rows"),
                unmatched.cast("long").alias("unmatched_rows"),
                count_if(missed).cast("long").alias("unmatched_unique_zip_codes"),
                pct(with_zip - unmatched, with_zip).alias("coverage_pct"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- C10/C15 order rules
def order_rule_masks() -> dict[str, Column]:
    """The eight order rules; each mask is NULL-safe (NULL -> false)."""
    p, a = F.col("order_purchase_timestamp"), F.col("order_approved_at")
    c, d = F.col("order_delivered_carrier_date"), F.col("order_delivered_customer_date")
    e, s = F.col("order_estimated_delivery_date"), F.col("order_status")
    m = {
        "approval_before_purchase": a.isNotNull() & (a < p),
        "carrier_before_purchase": c.isNotNull() & (c < p),
        "carrier_before_approval": c.isNotNull() & a.isNotNull() & (c < a),
        "delivery_before_carrier": d.isNotNull() & c.isNotNull() & (d < c),
        "delivery_before_purchase": d.isNotNull() & (d < p),
        "estimated_before_purchase": e.isNotNull() & (e < p),
        "delivered_status_missing_delivery_date": (s == "delivered") & d.isNull(),
        "non_delivered_status_with_delivery_date": ~F.coalesce(s == "delivered", F.lit(False)) & d.isNotNull(),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in m.items()}


def add_order_flags(orders: DataFrame) -> DataFrame:
    m = order_rule_masks()
    anomaly = reduce(lambda x, y: x | y, [m[r] for r in TIMESTAMP_RULES])
    mismatch = reduce(lambda x, y: x | y, [m[r] for r in STATUS_RULES])
    return orders.withColumns(
        {"has_timestamp_anomaly": anomaly, "has_status_date_mismatch": mismatch}
    ).withColumn(
        "is_valid_delivery_record",
        (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull() & ~F.col("has_timestamp_anomaly"),
    )


def order_timestamp_checks(orders: DataFrame) -> DataFrame:
    """Affected rows per rule, all eight counted in one pass."""
    m = order_rule_masks()
    one = orders.agg(*[F.count_if(v).alias(k) for k, v in m.items()])
    return one.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).cast("long").alias("affected_rows")) for k in m])).alias("r")
    ).select("r.*")


# ---------------------------------------------------------------- C14 treatment
def treat_payments(payments: DataFrame) -> DataFrame:
    i = F.col("payment_installments")
    return payments.withColumn("payment_installments", F.when(i < 1, F.lit(1)).otherwise(i).cast("int"))


def treat_products(products: DataFrame) -> DataFrame:
    w = F.col("product_weight_g")
    return products.withColumn("product_weight_g", F.when(w.isNotNull() & (w <= 0), F.lit(None)).otherwise(w))


# ---------------------------------------------------------------- full job
def dates_and_zips(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables as they enter the text step (C1 and C2 applied)."""
    out = {}
    for name, df in raw.items():
        if name in DATE_COLUMNS:
            df = convert_dates(df, DATE_COLUMNS[name])
        if name in ZIP_COLUMNS:
            df = df.withColumn(ZIP_COLUMNS[name], standardize_zip(ZIP_COLUMNS[name]))
        out[name] = df
    return out


def standardize(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Dates, ZIP codes and text (C1-C3), before any repair."""
    out = {}
    for name, df in raw.items():
        if name in DATE_COLUMNS:
            df = convert_dates(df, DATE_COLUMNS[name])
        if name in ZIP_COLUMNS:
            df = df.withColumn(ZIP_COLUMNS[name], standardize_zip(ZIP_COLUMNS[name]))
        out[name] = standardize_text(df)
    return out


def clean_tables(raw: dict[str, DataFrame], manual_translations: list[tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """Raw nine tables -> clean nine tables with the clean-layer schema."""
    t = standardize(raw)
    translation = repair_translation(t["category_translation"], manual_translations)
    products = treat_products(repair_products(t["products"], translation))
    payments = treat_payments(t["payments"])
    orders = add_order_flags(t["orders"])
    items = t["order_items"].withColumns(
        {
            "order_item_id": F.col("order_item_id").cast("int"),
            "price": F.col("price").cast("decimal(12,2)"),
            "freight_value": F.col("freight_value").cast("decimal(12,2)"),
        }
    )
    payments = payments.withColumns(
        {"payment_sequential": F.col("payment_sequential").cast("int"), "payment_value": F.col("payment_value").cast("decimal(12,2)")}
    )
    reviews = t["reviews"].withColumn("review_score", F.col("review_score").cast("short"))
    frames = {
        "customers": t["customers"],
        "geolocation": clean_geolocation(t["geolocation"]),
        "order_items": items,
        "payments": payments,
        "reviews": reviews,
        "orders": orders,
        "products": products,
        "sellers": t["sellers"],
        "category_translation": translation,
    }
    return {name: conform(df, CLEAN_COLUMNS[name]) for name, df in frames.items()}
