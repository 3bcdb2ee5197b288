"""Sources and sinks: CSV with quoted newlines, typed re-read, ordered export, file inventory."""

from pyspark.sql import functions as F

from marketlens.sources import io
from marketlens.sources.schemas import RAW_COLUMNS


def test_multiline_review_text_is_one_row(spark, tmp_path):
    p = tmp_path / "reviews.csv"
    p.write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,,"line one\nline two, with ""quotes""",2018-01-01 00:00:00,2018-01-02 10:00:00\n'
        "r2,o2,1,,,2018-01-03 00:00:00,2018-01-04 00:00:00\n"
    )
    df = io.read_raw_csv(spark, {"reviews": str(p)})["reviews"]
    rows = df.orderBy("review_id").collect()
    assert len(rows) == 2
    assert rows[0]["review_comment_message"] == 'line one\nline two, with "quotes"'
    assert [f.name for f in df.schema.fields] == [c for c, _ in RAW_COLUMNS["reviews"]]


def test_zip_keeps_leading_zero_when_read_as_text_then_cleaned(spark, tmp_path):
    p = tmp_path / "sellers.csv"
    p.write_text("seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01001,sao paulo,SP\n")
    df = io.read_raw_csv(spark, {"sellers": str(p)})["sellers"]
    from marketlens.operators.cleaning import standardize_zip

    assert df.select(standardize_zip("seller_zip_code_prefix")).first()[0] == "01001"


def test_export_and_reread_report(spark, tmp_path):
    df = spark.createDataFrame([("2017-02-01", 2), ("2017-01-01", 1)], "m string, n int").withColumn("m", F.to_date("m"))
    out = str(tmp_path / "report")
    io.export_report(df, out, order=[F.col("m")])
    back = io.read_report(spark, out, "m DATE, n INT")
    assert [tuple(r) for r in back.collect()][0][1] == 1
    assert str(back.schema["m"].dataType) == "DateType()"


def test_file_inventory_and_row_counts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    inv = io.file_inventory(spark, str(tmp_path / "*.csv")).collect()
    assert inv[0]["file_name"] == "a.csv"
    counts = io.table_row_counts({"t": spark.range(3)}).collect()
    assert counts[0]["row_count"] == 3


def test_clean_csv_round_trip_and_fail_fast(spark, tmp_path):
    import pytest

    from marketlens.plans.catalog import marketplace
    from conftest import SF_SMALL

    clean = marketplace(spark, SF_SMALL).clean
    tables = {t: clean[t] for t in ("payments", "reviews", "orders", "products")}
    io.write_layer(tables, str(tmp_path / "layer"), fmt="csv")
    back = io.read_clean_csv(spark, {t: str(tmp_path / "layer" / t) for t in tables})
    for t, df in tables.items():
        assert back[t].schema.simpleString() == df.schema.simpleString()
        assert back[t].exceptAll(df).isEmpty() and df.exceptAll(back[t]).isEmpty(), t
    bad = tmp_path / "bad.csv"
    bad.write_text("order_id,payment_sequential,payment_type,payment_installments,payment_value\no1,x,boleto,1,2.00\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_clean_csv(spark, {"payments": str(bad)})["payments"].collect()


def test_parquet_layer_round_trip(spark, tmp_path):
    frames = {"t": spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")}
    io.write_layer(frames, str(tmp_path / "p"))
    assert sorted(tuple(r) for r in io.read_layer(spark, str(tmp_path / "p"), ["t"])["t"].collect()) == [(1, "a"), (2, None)]


def test_report_catalogue(spark, tmp_path):
    from marketlens.plans.registry import ALL_QUERIES
    from conftest import SF_SMALL

    assert len(io.REPORTS) == 23 and all(r.query in ALL_QUERIES for r in io.REPORTS.values())
    frames = {q: ALL_QUERIES[q](spark, SF_SMALL) for q in ("monthly_sales", "seller_performance", "sales_kpis")}
    assert sorted(io.export_reports(frames, str(tmp_path))) == ["monthly_sales_metrics", "overall_sales_kpis", "seller_performance"]
    months = [r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "monthly_sales_metrics")).select("sales_month").collect()]
    assert months == sorted(months) and len(months) > 3
    # part files in name order are the report's order
    values = []
    for f in sorted((tmp_path / "seller_performance").glob("part-*")):
        head, *lines = f.read_text().splitlines()
        values += [float(x.split(",")[head.split(",").index("item_price_total")]) for x in lines]
    assert values == sorted(values, reverse=True)


def test_rejected_rows_keep_their_file_and_reason(spark, tmp_path):
    from marketlens.sources import rejects

    head = "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
    (tmp_path / "a.csv").write_text(head + "o1,1,boleto,1,2.50\no2,x,boleto,1,2.00\no3,1,card\no4,1,,,\n")
    (tmp_path / "b.csv").write_text(head + 'o5,1,"two, words",3,9\no6,1,card,1,7.00,more\no7,1,card,1,zero\n')
    (tmp_path / "r.csv").write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,,"line one\nline two",2018-01-01 00:00:00,2018-01-02 10:00:00\nr2,o2,five,,"a\nb",2018-01-03 00:00:00,2018-01-04 00:00:00\n'
    )
    frames, bad = rejects.land_raw_csv(spark, {"payments": str(tmp_path / "[ab].csv"), "reviews": str(tmp_path / "r.csv")}, str(tmp_path / "landed"))
    assert sorted(r[0] for r in frames["payments"].collect()) == ["o1", "o4", "o5"]
    assert frames["payments"].where("order_id = 'o5'").first()["payment_type"] == "two, words"
    assert [r["review_comment_message"] for r in frames["reviews"].collect()] == ["line one\nline two"]
    got = sorted((r.table_name, r.file_name, r.record.split(",")[0], r.reason) for r in bad.collect())
    assert got == [
        ("payments", "a.csv", "o2", "payment_sequential is not int"),
        ("payments", "a.csv", "o3", "too few columns"),
        ("payments", "b.csv", "o6", "too many columns"),
        ("payments", "b.csv", "o7", "payment_value is not double"),
        ("reviews", "r.csv", "r2", "review_score is not int"),
    ]
    assert {tuple(r) for r in rejects.reject_counts(bad).where("table_name = 'reviews'").collect()} == {("reviews", "review_score is not int", 1)}
    assert [f.name for f in frames["payments"].schema.fields] == [c for c, _ in RAW_COLUMNS["payments"]]


def test_no_rejects_without_faults(spark, tmp_path):
    from marketlens.sources import rejects

    (tmp_path / "s.csv").write_text("seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01001,x,SP\n")
    frames, bad = rejects.land_raw_csv(spark, {"sellers": str(tmp_path / "s.csv")}, str(tmp_path / "landed"))
    assert frames["sellers"].count() == 1 and bad.count() == 0


def test_file_profile(spark, tmp_path):
    from marketlens.sources import rejects

    head = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"
    (tmp_path / "one.csv").write_text(head + "s1,1,x,SP\ns1,1,x,SP\ns2,,,\n")
    (tmp_path / "two.csv").write_text(head + "s1,1,x,SP\n" + "".join(f"t{i},{i},{'city' * 30},RJ\n" for i in range(20_000)))
    profile = rejects.file_profile(spark, {"sellers": str(tmp_path / "*.csv")})
    assert profile.columns == ["file_name", "rows", "columns", "duplicate_rows", "missing_cells", "file_size_mb"]
    got = {r.file_name: tuple(r)[1:] for r in profile.collect()}
    assert got["one.csv"] == (3, 4, 1, 3, 0.0)
    assert got["two.csv"] == (20_001, 4, 0, 0, round((tmp_path / "two.csv").stat().st_size / 1024**2, 2))
