"""Adapter: driver test tables -> the nine raw marketplace tables.

The test data is a TPC-H-like star schema; the analytics expect the nine
marketplace tables (orders, customers, order_items, payments, reviews,
products, sellers, category_translation, geolocation). Every mapping is a
deterministic column expression (FIXTURES.md section B), so DuckDB can build
the same rows from the same parquet files (see ``plans/sqlbase.py``).

The raw tables keep the defects the cleaning job must repair: timestamps as
text, ZIP codes as integers, zero installments, zero weights, missing and
untranslated categories, padded and blank text, duplicate and out-of-range
geolocation rows.

Scale notes: ``orders`` and ``lineitem`` are the only large inputs; they are
joined once on the order key (one shuffle each), which also numbers the items. ``nation`` is the fixed
25-row TPC-H dimension, so broadcasting it is bounded by the spec, not by the
data volume. ``customer`` and ``supplier`` grow with the scale factor and are
joined without a broadcast hint; AQE picks the strategy from runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.operators.ranking import number_rows
from marketlens.sources.schemas import RAW_COLUMNS, conform

# Fixed values of the adapter (FIXTURES.md B); both twins must use them.
BASE_TIMESTAMP = "2016-09-04 00:00:00"
ORDER_DATE_ORIGIN = "1995-01-01"
PURCHASE_DAY_SPAN = 780
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
UNTRANSLATED_CATEGORY = "economy_4"
#: Every so many orders have an approval time in a form that the strict format rejects.
MALFORMED_EVERY = 613
#: Invariants of the cleaning job that the adapter's defects break on purpose.
KNOWN_FAILURES = frozenset({"no_date_parse_failures"})
#: Sellers up to this revenue rank count as high value; lower than on real data, so that every risk segment occurs.
HIGH_VALUE_RANK = 10
PAYMENT_TYPE_BY_FLAG = {"A": "boleto", "N": "credit_card", "R": "voucher"}


def _days(n) -> F.Column:
    return F.make_dt_interval(n, F.lit(0), F.lit(0), F.lit(0))


def _hours(n) -> F.Column:
    return F.make_dt_interval(F.lit(0), n, F.lit(0), F.lit(0))


def _text_ts(c: F.Column) -> F.Column:
    return F.date_format(c, TS_FORMAT)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source order with the derived purchase timeline."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    k = F.col("o_orderkey")
    day_offset = F.pmod(F.datediff(F.to_date("o_orderdate"), F.lit(ORDER_DATE_ORIGIN).cast("date")), F.lit(PURCHASE_DAY_SPAN))
    sec_offset = F.pmod(k * 7919, F.lit(86400))
    ts = F.lit(BASE_TIMESTAMP).cast("timestamp_ntz") + F.make_dt_interval(day_offset, F.lit(0), F.lit(0), sec_offset)
    status = (
        F.when(F.col("o_orderstatus").isin("F", "P"), F.lit("delivered"))
        .when(F.pmod(k, F.lit(5)) == 0, F.lit("canceled"))
        .when(F.pmod(k, F.lit(5)) == 1, F.lit("shipped"))
        .otherwise(F.lit("delivered"))
    )
    o = o.withColumns({"ts": ts, "status": status})
    approved = F.when(F.pmod(k, F.lit(61)) != 0, F.col("ts") + _hours(F.pmod(k, F.lit(50))))
    carrier = (
        F.when(F.col("status") == "canceled", F.lit(None))
        .when(F.pmod(k, F.lit(97)) == 0, F.col("ts") - _days(F.lit(1)))
        .otherwise(F.col("ts") + _days(1 + F.pmod(k, F.lit(6))))
    )
    delivered = F.when(
        ((F.col("status") == "delivered") & (F.pmod(k, F.lit(113)) != 0))
        | ((F.col("status") == "shipped") & (F.pmod(k, F.lit(17)) == 0)),
        F.col("ts") + _days(3 + F.pmod(k * 13, F.lit(31))),
    )
    estimated = F.date_add(F.to_date("ts"), (20 + F.pmod(F.col("o_custkey"), F.lit(10))).cast("int")).cast("timestamp_ntz")
    return o.withColumns({"approved": approved, "carrier": carrier, "delivered": delivered, "estimated": estimated})


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nine raw tables, typed as a CSV reader would type them."""
    nation = F.broadcast(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    of = _order_frame(spark, sf_dir)
    k = F.col("o_orderkey")

    orders = of.select(
        k.cast("string").alias("order_id"),
        k.cast("string").alias("customer_id"),
        F.col("status").alias("order_status"),
        _text_ts(F.col("ts")).alias("order_purchase_timestamp"),
        F.when(F.pmod(k, F.lit(MALFORMED_EVERY)) == 0, F.replace(_text_ts(F.col("approved")), F.lit(" "), F.lit("T")))
        .otherwise(_text_ts(F.col("approved")))
        .alias("order_approved_at"),
        _text_ts(F.col("carrier")).alias("order_delivered_carrier_date"),
        _text_ts(F.col("delivered")).alias("order_delivered_customer_date"),
        _text_ts(F.col("estimated")).alias("order_estimated_delivery_date"),
    )

    cust = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    ck = F.col("o_custkey")
    customers = (
        of.select("o_orderkey", "o_custkey")
        .join(cust, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            k.cast("string").alias("customer_id"),
            F.when(F.pmod(ck, F.lit(5)) == 0, F.concat(F.lit("R"), ck.cast("string")))
            .when(F.pmod(ck, F.lit(5)) == 1, F.concat(F.lit("P"), ck.cast("string"), F.lit("-"), F.pmod(k, F.lit(5)).cast("string")))
            .otherwise(F.concat(F.lit("S"), k.cast("string")))
            .alias("customer_unique_id"),
            F.pmod(ck, F.lit(100000)).cast("int").alias("customer_zip_code_prefix"),
            F.concat(F.lit("city_"), F.pmod(k, F.lit(11)).cast("string")).alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )

    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    li = li.withColumn("order_id", F.col("l_orderkey").cast("string")).drop("l_orderkey")
    # order_item_id = ROW_NUMBER() per order; huge orders are numbered apart,
    # so none lands in a single task (see ranking.number_rows). Items and
    # payments are dealt by the order id as text, which is also the clean
    # layer's bucket, so they are dealt once.
    numbered = number_rows(
        li.drop("l_returnflag"),
        of.select(k.cast("string").alias("order_id"), "ts"),
        "order_id",
        [(c, False) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "ts")],
        out="order_item_id",
    )
    order_items = numbered.select(
        "order_id",
        F.col("order_item_id").cast("int").alias("order_item_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_suppkey").cast("string").alias("seller_id"),
        _text_ts(F.col("ts") + _days(2 + F.pmod(F.col("l_linenumber"), F.lit(4)))).alias("shipping_limit_date"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("freight_value"),
    )

    type_map = F.create_map(*[x for kv in PAYMENT_TYPE_BY_FLAG.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    pay_w = Window.partitionBy("order_id").orderBy("l_returnflag")
    payments = (
        li.groupBy("order_id", "l_returnflag")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("l_extendedprice").cast("decimal(12,2)") + F.col("l_quantity").cast("decimal(12,2)")).alias("v"),
        )
        .select(
            "order_id",
            F.row_number().over(pay_w).cast("int").alias("payment_sequential"),
            type_map[F.col("l_returnflag")].alias("payment_type"),
            F.when(F.pmod(F.col("order_id").cast("long"), F.lit(199)) == 0, F.lit(0)).otherwise(F.col("n")).cast("int").alias("payment_installments"),
            F.col("v").cast("double").alias("payment_value"),
        )
    )

    ev = _read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "props")
    e = F.col("event_id")
    reviews = ev.select(
        F.concat(F.lit("V"), e.cast("string")).alias("review_id"),
        (e - F.when(F.col("event_type") == "error", F.pmod(e, F.lit(2))).otherwise(F.lit(0))).cast("string").alias("order_id"),
        (1 + F.pmod(F.floor("value"), F.lit(5))).cast("int").alias("review_score"),
        F.when(F.pmod(e, F.lit(3)) == 0, F.concat(F.lit(" "), F.col("event_type"), F.lit(" "))).alias("review_comment_title"),
        F.when(F.col("event_type") == "click", F.lit(None).cast("string"))
        .when(F.col("event_type") == "view", F.lit("   "))
        .otherwise(F.col("props"))
        .alias("review_comment_message"),
        _text_ts(F.col("ts")).alias("review_creation_date"),
        _text_ts(F.col("ts") + _hours(1 + F.pmod(e, F.lit(72)))).alias("review_answer_timestamp"),
    )

    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    pk = F.col("p_partkey")
    category = F.when(F.pmod(pk, F.lit(53)) != 0, F.concat(F.lower("p_type"), F.lit("_"), F.pmod(pk, F.lit(5)).cast("string")))
    products = part.select(
        pk.cast("string").alias("product_id"),
        category.alias("product_category_name"),
        F.length("p_name").cast("double").alias("product_name_lenght"),
        (F.length("p_name") * 3).cast("double").alias("product_description_lenght"),
        (1 + F.pmod(pk, F.lit(4))).cast("double").alias("product_photos_qty"),
        F.when(F.pmod(pk, F.lit(101)) == 0, F.lit(0.0)).otherwise(F.col("p_size") * 100.0).alias("product_weight_g"),
        (F.col("p_size") + 10.0).alias("product_length_cm"),
        (F.col("p_size") / 2.0 + 2.0).alias("product_height_cm"),
        (F.col("p_size") + 5.0).alias("product_width_cm"),
    )
    category_translation = (
        part.select(category.alias("product_category_name"))
        .where(F.col("product_category_name").isNotNull() & (F.col("product_category_name") != UNTRANSLATED_CATEGORY))
        .distinct()
        .select("product_category_name", F.concat(F.lit("en_"), F.col("product_category_name")).alias("product_category_name_english"))
    )

    sup = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    sk = F.col("s_suppkey")
    sellers = sup.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        sk.cast("string").alias("seller_id"),
        F.pmod(sk * 37, F.lit(100000)).cast("int").alias("seller_zip_code_prefix"),
        F.concat(F.lit("scity_"), F.pmod(sk, F.lit(7)).cast("string")).alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )

    cgeo = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    cgeo = cgeo.unionByName(cgeo.where(F.pmod(F.col("c_custkey"), F.lit(4)) == 0))
    geolocation = cgeo.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.pmod(F.col("c_custkey"), F.lit(400)).cast("int").alias("geolocation_zip_code_prefix"),
        (F.col("c_acctbal") / 100.0).alias("geolocation_lat"),
        (F.col("c_acctbal") / 60.0).alias("geolocation_lng"),
        F.concat(F.lit("g"), F.pmod(F.col("c_custkey"), F.lit(3)).cast("string")).alias("geolocation_city"),
        F.col("n_name").alias("geolocation_state"),
    )

    frames = {
        "customers": customers,
        "geolocation": geolocation,
        "order_items": order_items,
        "payments": payments,
        "reviews": reviews,
        "orders": orders,
        "products": products,
        "sellers": sellers,
        "category_translation": category_translation,
    }
    return {t: conform(df, RAW_COLUMNS[t]) for t, df in frames.items()}
