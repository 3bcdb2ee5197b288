"""Cleaning rules: ZIP padding, text stripping, date coercion, mode ties, geolocation."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators import cleaning


def test_zip_padding_keeps_long_values(spark):
    df = spark.createDataFrame([("123",), ("1234567",), ("abc",), (None,), ("01001",)], "z string")
    got = [r[0] for r in df.select(cleaning.standardize_zip("z")).collect()]
    assert got == ["00123", "1234567", None, None, "01001"]


def test_strip_and_blank_to_null(spark):
    df = spark.createDataFrame([("  a b \t",), ("   ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(cleaning.strip_text("t")).collect()] == ["a b", None, None, None]


def test_date_parse_failure_is_null(spark):
    df = spark.createDataFrame([("2017-01-02 03:04:05",), ("not a date",), (None,)], "d string")
    got = [r[0] for r in df.select(cleaning.parse_timestamp("d")).collect()]
    assert got[0].year == 2017 and got[1] is None and got[2] is None


def test_geolocation_mode_tie_and_median(spark):
    rows = [
        (1, 10.0, 20.0, "b", "S"),
        (1, 10.0, 20.0, "b", "S"),  # exact duplicate, removed
        (1, 12.0, 22.0, "a", "S"),
        (1, 95.0, 22.0, "z", "S"),  # invalid latitude, removed
        (2, 1.0, 1.0, "x", "T"),
    ]
    geo = spark.createDataFrame(rows, "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, geolocation_city string, geolocation_state string")
    out = {r[0]: r for r in cleaning.clean_geolocation(geo).collect()}
    assert out[1]["geolocation_city"] == "a"  # tie between a and b -> smallest
    assert out[1]["geolocation_lat"] == 11.0 and out[1]["geolocation_observation_count"] == 2


def test_order_flags(spark):
    df = spark.createDataFrame(
        [("delivered", "2017-01-02 00:00:00", None, "2017-01-01 00:00:00", "2017-01-05 00:00:00", "2017-01-10 00:00:00")],
        "order_status string, order_purchase_timestamp string, order_approved_at string, order_delivered_carrier_date string, "
        "order_delivered_customer_date string, order_estimated_delivery_date string",
    )
    df = cleaning.convert_dates(df, cleaning.DATE_COLUMNS["orders"])
    r = cleaning.add_order_flags(df).first()
    assert r["has_timestamp_anomaly"] is True  # carrier before purchase
    assert r["is_valid_delivery_record"] is False and r["has_status_date_mismatch"] is False


def test_treatments(spark):
    p = spark.createDataFrame([(0,), (2,)], "payment_installments int")
    assert [r[0] for r in cleaning.treat_payments(p).collect()] == [1, 2]
    w = spark.createDataFrame([(0.0,), (5.0,), (None,)], "product_weight_g double")
    assert [r[0] for r in cleaning.treat_products(w).select(F.col("product_weight_g")).collect()] == [None, 5.0, None]



def test_final_assertions_hold_on_test_tables(spark):
    from conftest import SF_SMALL

    from marketlens.operators import observed
    from marketlens.plans.catalog import marketplace

    m = marketplace(spark, SF_SMALL)
    of = m.metrics("raw"), m.metrics("clean"), m.clean["geolocation"]
    rows = observed.final_assertions(*of).collect()
    failing = {r["assertion"]: r["failing_rows"] for r in rows if not r["passed"]}
    # the adapter plants malformed approval times
    assert len(rows) == 13 and set(failing) == {"no_date_parse_failures"} and failing["no_date_parse_failures"] > 0
    observed.assert_clean(*of, known=frozenset({"no_date_parse_failures"}))  # does not raise
    with pytest.raises(AssertionError, match="no_date_parse_failures"):
        observed.assert_clean(*of)


def test_observed_metrics_equal_a_scan(spark):
    from conftest import SF_SMALL

    from marketlens.operators import observed
    from marketlens.plans.catalog import marketplace

    m = marketplace(spark, SF_SMALL)
    assert m.metrics("raw") == observed.measure(m.raw, observed.RAW_CHECKS)
    assert m.metrics("clean") == observed.measure(m.clean, observed.CLEAN_CHECKS)


def test_a_broken_layer_is_noticed_by_its_landing(spark, tmp_path):
    from marketlens.operators import observed

    bad = spark.createDataFrame([(0, "a"), (2, None), (None, "c")], "payment_installments int, note string")
    seen, metrics = observed.observed(bad, "payments", observed.CLEAN_CHECKS["payments"])
    seen.write.parquet(str(tmp_path / "p"))
    assert metrics.get == {"rows": 3, "missing:payment_installments": 1, "missing:note": 1, "installments_below_one": 1}


@pytest.mark.parametrize(
    "text,parsed",
    [
        ("2017-10-02 10:11:12", "2017-10-02 10:11:12"), ("2017-1-2 3:04:05", "2017-01-02 03:04:05"), ("2017", None), ("2017-10", None), ("2017-10-02", None),
        ("2017-10-02T10:11:12", None), ("2017-10-02 10:11:12.5", None), ("2017-10-02 10:11:12+03:00", None), (" 2017-01-02 03:04:05", None),
        ("2017-01-02 03:04:05 ", None), ("2017-01-02 03:04:05\n", None), ("2017-02-30 00:00:00", None), ("2017-01-02 24:00:00", None), (None, None),
    ],
)
def test_timestamps_parse_strictly(spark, text, parsed):
    from marketlens.operators.cleaning import parse_timestamp

    got = spark.createDataFrame([(text,)], "t string").select(parse_timestamp("t").cast("string")).first()[0]
    assert got == parsed


@pytest.mark.parametrize("text,code", [("1234.0", "01234"), ("-12", "-0012"), (" 77 ", "00077"), ("1e3", "01000"), ("+5", "00005"), ("123456", "123456"), ("12.5", None), ("0x1f", None), ("1d", None), ("", None), ("abc", None), ("inf", None), (None, None)])
def test_zip_codes_follow_numeric_text(spark, text, code):
    from marketlens.operators.cleaning import standardize_zip, whole_number

    r = spark.createDataFrame([(text,)], "z string").select(standardize_zip("z"), whole_number("z").isNull()).first()
    assert (r[0], r[1]) == (code, code is None)


def test_duplicate_translation_stops_the_join(spark):
    from marketlens.operators.cleaning import repair_products

    products = spark.createDataFrame([("p1", "pc_gamer"), ("p2", "other")], "product_id string, product_category_name string")
    ok = spark.createDataFrame([("pc_gamer", "gaming_pc")], "product_category_name string, product_category_name_english string")
    assert {tuple(r) for r in repair_products(products, ok).collect()} == {("p1", "pc_gamer", "gaming_pc"), ("p2", "other", None)}
    with pytest.raises(Exception, match="duplicate translation of category pc_gamer"):
        repair_products(products, ok.union(ok)).collect()


def test_median_of_a_hot_zip_with_one_value(spark):
    """Nine in ten rows agree in ZIP code and value: they are one weighted row before anything is ranked."""
    from marketlens.operators.cleaning import group_median

    rows = [("z", 1.5)] * 4500 + [("z", float(i)) for i in range(200)] + [(f"k{i % 7}", float(i)) for i in range(301)] + [("n", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in group_median(frame, "k", "v", "m").collect()}
    import statistics

    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert got == {k: statistics.median(v) for k, v in want.items()}


def test_geolocation_report_has_the_report_metrics(spark):
    from marketlens.operators.cleaning import geolocation_report

    raw = spark.createDataFrame([(1, 10.0, 1.0, "a", "X"), (1, 10.0, 1.0, "a", "X"), (2, 99.0, 1.0, "a", "X"), (2, 99.0, 1.0, "a", "X"), (3, None, 1.0, "b", "X")], "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, geolocation_city string, geolocation_state string")
    clean = spark.createDataFrame([("00001",), ("00003",)], "geolocation_zip_code_prefix string")
    got = {r.metric: r.value for r in geolocation_report(raw, clean).collect()}
    assert got == {"raw_rows": 5, "exact_duplicate_rows": 2, "invalid_coordinate_rows": 3, "unique_zip_codes_before": 3, "clean_rows": 2, "duplicate_zip_codes_after": 0}


def test_each_order_rule_fires_alone(spark):
    from datetime import datetime as d

    p = d(2017, 1, 10)
    cases = {
        "approval_before_purchase": ("delivered", d(2017, 1, 9), d(2017, 1, 11), d(2017, 1, 15), d(2017, 1, 30)),
        "carrier_before_purchase": ("delivered", d(2017, 1, 8), d(2017, 1, 9), d(2017, 1, 15), d(2017, 1, 30)),
        "carrier_before_approval": ("delivered", d(2017, 1, 12), d(2017, 1, 11), d(2017, 1, 15), d(2017, 1, 30)),
        "delivery_before_carrier": ("delivered", d(2017, 1, 10, 1), d(2017, 1, 14), d(2017, 1, 13), d(2017, 1, 30)),
        "estimated_before_purchase": ("delivered", d(2017, 1, 10, 1), d(2017, 1, 11), d(2017, 1, 15), d(2017, 1, 9)),
        "delivered_status_missing_delivery_date": ("delivered", d(2017, 1, 10, 1), d(2017, 1, 11), None, d(2017, 1, 30)),
        "non_delivered_status_with_delivery_date": ("shipped", d(2017, 1, 10, 1), d(2017, 1, 11), d(2017, 1, 15), d(2017, 1, 30)),
    }
    rows = [(name, st, p, a, c, dl, e) for name, (st, a, c, dl, e) in cases.items()]
    df = spark.createDataFrame(
        rows,
        "case string, order_status string, order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
        "order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
    )
    masks = cleaning.order_rule_masks()
    got = df.select("case", *[m.alias(k) for k, m in masks.items()]).collect()
    for r in got:
        fired = {k for k in masks if r[k]}
        if r["case"] == "delivery_before_carrier":
            assert fired == {"delivery_before_carrier"}
        else:
            assert r["case"] in fired
    flagged = {r["case"]: r for r in cleaning.add_order_flags(df).collect()}
    assert flagged["non_delivered_status_with_delivery_date"]["has_status_date_mismatch"] is True
    assert flagged["estimated_before_purchase"]["is_valid_delivery_record"] is False


def test_strip_takes_the_whitespace_of_the_pattern_without_matching(spark):
    points = [p for p in range(1, 0x3100) if not 0xD800 <= p < 0xE000]
    df = spark.createDataFrame([(p, f"{chr(p)}\n a {chr(p)} b{chr(p)}{chr(p)}") for p in points], "p int, t string")
    want = F.nullif(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""), F.lit(""))
    assert df.where(~cleaning.strip_text("t").eqNullSafe(want)).isEmpty()
    assert "regexp" not in str(cleaning.strip_text("t"))


def test_large_tables_are_cleaned_in_the_pass_that_makes_them(spark):
    """The clean layer lands no raw copy of the bucketed tables; their raw metrics come from the same pass, and rows don't depend on
    whether the raw layer was landed before."""
    import os

    from conftest import SF_SMALL

    from marketlens.operators import observed
    from marketlens.plans.catalog import BUCKETS, TEST_MANUAL_TRANSLATIONS, Marketplace

    m = Marketplace(spark, SF_SMALL)
    try:
        clean = m.clean
        assert not {t for t in BUCKETS if os.path.exists(f"{m._folder}/raw/{t}")}
        seen = dict(m._metrics["raw"])
        assert seen == observed.measure(m.raw, observed.RAW_CHECKS) and set(seen) == set(m.raw)
        again = cleaning.clean_tables(m.raw, TEST_MANUAL_TRANSLATIONS)
        for t in BUCKETS:
            assert clean[t].exceptAll(again[t]).isEmpty() and again[t].exceptAll(clean[t]).isEmpty()
    finally:
        m.close()


def test_items_and_payments_are_dealt_out_once(spark):
    from conftest import SF_SMALL

    from marketlens.sources import testdata

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        raw = testdata.raw_tables(spark, SF_SMALL)
        for t in ("order_items", "payments"):
            plan = raw[t].repartition(8, "order_id")._jdf.queryExecution().executedPlan().toString()
            assert "REPARTITION" not in plan and plan.count("hashpartitioning(order_id") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
