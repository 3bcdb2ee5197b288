"""Semantic traps: each rule has a direct test."""

from decimal import Decimal

from pyspark.sql import functions as F

from marketlens.operators import model, operations, rfm, sales


def test_t5_empty_series_for_negative_span(spark):
    n = F.lit(-1)
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.when(n >= 0, n))).alias("k")).collect()
    assert rows == []


def test_t6_distinct_row_values_count_null_members(spark):
    df = spark.createDataFrame([("a", None), ("a", 1), ("b", None)], "x string, y int")
    assert df.agg(F.count_distinct(F.struct("x", "y"))).first()[0] == 3


def test_t7_type_list_is_null_when_empty(spark):
    p = spark.createDataFrame([("o1", 1, None, 1, Decimal("1.00"))], "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value decimal(12,2)")
    r = model.payments_agg(p).first()
    assert r["payment_types"] is None and r["payment_type_count"] == 0


def test_t8_rfm_code_and_segment_ladder_order(spark):
    df = spark.createDataFrame([(5, 1, 3, 1), (4, 1, 1, 1), (2, 1, 5, 1), (0, 0, 0, 0)], "r int, f int, m int, c int")
    out = df.select(
        F.concat_ws("", *[F.col(c).cast("string") for c in "rfm"]).alias("code"),
        rfm.segment_expr(F.col("r"), F.col("f"), F.col("m"), F.col("c")).alias("seg"),
    ).collect()
    assert [r["code"] for r in out] == ["513", "411", "215", "000"]
    # R=5,F=1 is "New Customers" before "Promising"; R<=2 with M>=4 is "High Value at Risk"
    assert [r["seg"] for r in out] == ["New Customers", "Promising", "High Value at Risk", "No Completed Purchase"]


def test_t13_rounded_cumulative_share_meets_threshold(spark):
    # 49.996 % rounds to 50.00 and therefore already meets the 50 % threshold
    ranked = spark.createDataFrame(
        [(1, Decimal("50.00"), 4), (2, Decimal("80.00"), 4), (3, Decimal("95.00"), 4), (4, Decimal("100.00"), 4)],
        "product_position int, cumulative_item_revenue_pct decimal(6,2), total_product_count long",
    )
    got = {float(r["threshold_pct"]): r["products_required"] for r in sales.revenue_concentration(ranked).collect()}
    assert got == {50.0: 1, 80.0: 2, 90.0: 3, 95.0: 3}
    cum = spark.range(1).select(F.round(F.lit(Decimal("49.996")), 2).alias("x")).first()["x"]
    assert cum == Decimal("50.00")


def test_t14_unknown_lateness_goes_to_on_time_bucket(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "is_late_delivery boolean")
    got = [r[0] for r in df.select(operations.delivery_status_expr()).collect()]
    assert got == ["Late", "On Time or Early", "On Time or Early"]


def test_t9_division_by_zero_is_null_not_error(spark):
    from marketlens.functions.exprs import pct

    assert spark.range(1).select(pct(F.lit(1), F.lit(0))).first()[0] is None


def test_growth_after_empty_month(spark):
    """Calendar gap fill: an empty month gives -100 %, the month after it NULL."""
    from datetime import date

    rows = [
        ("o1", "u1", "delivered", date(2017, 1, 5), 1, Decimal("10.00"), Decimal("1.00"), Decimal("11.00")),
        ("o2", "u2", "delivered", date(2017, 3, 5), 1, Decimal("20.00"), Decimal("2.00"), Decimal("22.00")),
        ("o3", "u3", "canceled", date(2017, 2, 5), 1, Decimal("5.00"), Decimal("1.00"), Decimal("6.00")),
    ]
    os = spark.createDataFrame(
        rows,
        "order_id string, customer_unique_id string, order_status string, purchase_date date, item_count int, "
        "item_price_total decimal(14,2), freight_total decimal(14,2), payment_value_total decimal(14,2)",
    )
    got = {str(r["sales_month"]): r for r in sales.monthly_sales(os).collect()}
    assert list(sorted(got)) == ["2017-01-01", "2017-02-01", "2017-03-01"]
    assert got["2017-02-01"]["order_count"] == 0
    assert got["2017-02-01"]["payment_growth_pct"] == Decimal("-100.00")
    assert got["2017-03-01"]["payment_growth_pct"] is None
    assert got["2017-01-01"]["payment_growth_pct"] is None
