"""Order/item models and customer views on tiny hand-made frames (FIXTURES.md A cases)."""

from datetime import datetime
from decimal import Decimal

import pytest

from marketlens.operators import customers, model
from marketlens.operators.cleaning import add_order_flags

TS = "timestamp_ntz"


@pytest.fixture(scope="module")
def tables(spark):
    d = datetime
    orders = spark.createDataFrame(
        [
            # o1: delivered on the estimated day (not late), two sellers, two reviews
            ("o1", "c1", "delivered", d(2017, 1, 5, 10), d(2017, 1, 5, 12), d(2017, 1, 6), d(2017, 1, 20, 23), d(2017, 1, 20)),
            # o2: no items, no payments, no reviews; NULL delivery
            ("o2", "c2", "shipped", d(2017, 2, 1), None, d(2017, 2, 2), None, d(2017, 2, 20)),
            # o3 and o4: same person, equal timestamps -> latest location is the higher order_id
            ("o3", "c3", "delivered", d(2017, 3, 1), d(2017, 3, 1, 1), d(2017, 3, 2), d(2017, 3, 25), d(2017, 3, 20)),
            ("o4", "c4", "canceled", d(2017, 3, 1), None, None, None, d(2017, 3, 20)),
        ],
        f"order_id string, customer_id string, order_status string, order_purchase_timestamp {TS}, order_approved_at {TS}, "
        f"order_delivered_carrier_date {TS}, order_delivered_customer_date {TS}, order_estimated_delivery_date {TS}",
    )
    orders = add_order_flags(orders)
    cust = spark.createDataFrame(
        [("c1", "u1", "01001", "a", "SP"), ("c2", "u2", "02002", "b", "RJ"), ("c3", "u3", "03003", "c", "MG"), ("c4", "u3", "04004", "d", "BA")],
        "customer_id string, customer_unique_id string, customer_zip_code_prefix string, customer_city string, customer_state string",
    )
    items = spark.createDataFrame(
        [
            ("o1", 1, "p1", "s1", d(2017, 1, 7), Decimal("10.00"), Decimal("1.00")),
            ("o1", 2, "p2", "s2", d(2017, 1, 5), Decimal("5.50"), Decimal("0.50")),
            ("o3", 1, "p1", "s1", d(2017, 3, 5), Decimal("20.00"), Decimal("2.00")),
        ],
        f"order_id string, order_item_id int, product_id string, seller_id string, shipping_limit_date {TS}, "
        "price decimal(12,2), freight_value decimal(12,2)",
    )
    pays = spark.createDataFrame(
        [("o1", 1, "voucher", 1, Decimal("7.00")), ("o1", 2, "credit_card", 3, Decimal("10.00")), ("o3", 1, "boleto", 1, Decimal("22.00"))],
        "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value decimal(12,2)",
    )
    revs = spark.createDataFrame(
        [
            ("r1", "o1", 5, None, "   ", d(2017, 1, 21), d(2017, 1, 22)),
            ("r2", "o1", 2, None, None, d(2017, 1, 23), d(2017, 1, 24)),
            ("r3", "o3", 1, None, "bad", d(2017, 3, 26), d(2017, 3, 27)),
        ],
        f"review_id string, order_id string, review_score short, review_comment_title string, review_comment_message string, "
        f"review_creation_date {TS}, review_answer_timestamp {TS}",
    )
    return orders, cust, items, pays, revs


def test_order_summary_rules(tables):
    orders, cust, items, pays, revs = tables
    os = {r["order_id"]: r for r in model.order_summary(orders, cust, items, pays, revs).collect()}
    o1, o2 = os["o1"], os["o2"]
    assert o1["is_late_delivery"] is False and o1["delivery_delay_days"] == 0  # delivered on the estimated day
    assert o1["seller_count"] == 2 and o1["item_count"] == 2
    assert o1["gross_item_value"] == Decimal("17.00") and o1["payment_difference"] == Decimal("0.00")
    assert o1["payment_types"] == "credit_card, voucher" and o1["uses_voucher"] is True
    assert o1["average_review_score"] == Decimal("3.50") and o1["has_written_comment"] is False  # blank-only comment
    assert o1["approval_hours"] == Decimal("2.00")
    assert o2["item_count"] == 0 and o2["item_price_total"] is None  # counts coalesce, money does not
    assert o2["has_item_record"] is False and o2["has_payment_record"] is False and o2["payment_types"] is None
    assert o2["delivery_days"] is None and o2["is_late_delivery"] is None
    assert os["o3"]["is_late_delivery"] is True and os["o3"]["has_written_comment"] is True


def test_item_detail_breach_flag(tables):
    orders, cust, items, pays, revs = tables
    p = items.sparkSession.createDataFrame([("p1", "x", "en_x")], "product_id string, product_category_name string, product_category_name_english string")
    s = items.sparkSession.createDataFrame([("s1", "1", "c", "SP")], "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string")
    d = {(r["order_id"], r["order_item_id"]): r for r in model.order_item_detail(items, orders, cust, p, s).collect()}
    assert d[("o1", 2)]["shipped_after_shipping_limit"] is True  # carrier 01-06 > limit 01-05
    assert d[("o1", 1)]["shipped_after_shipping_limit"] is False
    assert d[("o1", 2)]["seller_state"] is None  # missing seller dimension kept (left join)


def test_latest_location_tie_takes_higher_order_id(tables):
    orders, cust, items, pays, revs = tables
    os = model.order_summary(orders, cust, items, pays, revs)
    cs = {r["customer_unique_id"]: r for r in customers.customer_summary(os).collect()}
    assert cs["u3"]["latest_zip_code_prefix"] == "04004"
    assert cs["u3"]["order_count"] == 2 and cs["u3"]["is_repeat_customer"] is True
    assert cs["u2"]["total_payment_value"] == Decimal("0.00")


def test_cohort_grid_is_dense(tables):
    orders, cust, items, pays, revs = tables
    os = model.order_summary(orders, cust, items, pays, revs)
    act = customers.customer_monthly_activity(os)
    ret = customers.cohort_retention(customers.month_sets(os), act)
    rows = ret.where("cohort_month = DATE '2017-01-01'").collect()
    assert sorted(r["months_since_first_order"] for r in rows) == [0, 1, 2]  # Jan..Mar even when inactive
    assert {r["months_since_first_order"]: r["retention_rate_pct"] for r in rows}[1] == Decimal("0.00")


def test_month_sets_over_many_years(spark):
    """Bitmaps of three words: counts per cohort and month equal distinct (customer, month) rows."""
    import datetime
    import random

    rng = random.Random(4)
    month = lambda i: datetime.date(2001 + i // 12, i % 12 + 1, 1)
    rows = [(f"c{rng.randrange(60)}", month(rng.choice([0, 63, 64, 127, 128, 149, rng.randrange(150)]))) for _ in range(900)] + [("hot", month(i)) for i in range(150)] * 3
    orders = spark.createDataFrame(rows, "customer_unique_id string, purchase_month date")
    sets = customers.month_sets(orders)
    assert len(sets.first().months) == 3
    first = {}
    for c, m in rows:
        first[c] = min(first.get(c, m), m)
    want = {}
    for c, m in set(rows):
        want[first[c], m] = want.get((first[c], m), 0) + 1
    assert {(r.cohort_month, r.activity_month): r.active_customer_count for r in customers.cohort_activity(sets).collect()} == want
    assert customers.cohort_activity(customers.month_sets(orders.limit(0))).count() == 0


def test_bitmaps_make_no_customer_month_rows(spark):
    orders = spark.createDataFrame([("a", None)], "customer_unique_id string, purchase_month date")
    plan = customers.month_sets(orders)._jdf.queryExecution().executedPlan().toString()
    assert "keys=[customer_unique_id" in plan and "purchase_month" not in plan.split("keys=[")[1].split("]")[0]


def test_a_model_is_landed_when_it_is_read(spark):
    """A report of one model doesn't land the other."""
    from conftest import SF_SMALL

    from marketlens.plans.catalog import Marketplace

    m = Marketplace(spark, SF_SMALL)
    try:
        assert m.order_summary.count() > 0 and "order_item_detail" not in vars(m)
        assert not any("model_order_item_detail" in t for t in m._tables)
        assert m.order_item_detail.count() > 0
    finally:
        m.close()


def test_sums_of_sums_stay_cents(spark):
    """No DECIMAL division; the totals are exact, and an item without freight counts in its price alone."""
    rows = [("o", f"p{i % 3}", "s", Decimal(i) / 100, Decimal("9999999999.99") if i else None) for i in range(50)]
    df = spark.createDataFrame(rows, "order_id string, product_id string, seller_id string, price decimal(12,2), freight_value decimal(12,2)")
    agg = model.order_items_agg(df)
    r = agg.first()
    assert (r.item_price_total, r.freight_total, r.gross_item_value) == (Decimal("12.25"), Decimal("489999999999.51"), Decimal("490000000011.76"))
    assert " / " not in agg._jdf.queryExecution().optimizedPlan().toString()
