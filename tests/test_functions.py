"""SQL table functions with parameters give what the DataFrame forms give."""

from conftest import SF_SMALL

from marketlens.operators import customers
from marketlens.plans import functions
from marketlens.plans.registry import ALL_QUERIES


def test_cohort_drill_down_from_sql(spark):
    functions.register_functions(spark, SF_SMALL, ["cohort_drill_down"])
    retention = ALL_QUERIES["cohort_retention"](spark, SF_SMALL)
    months = [r[0] for r in retention.select("cohort_month").distinct().orderBy("cohort_month").limit(3).collect()]
    for month in months:
        for k in (0, 1, 4):
            got = spark.sql(f"SELECT * FROM cohort_drill_down(DATE'{month}', {k})").collect()
            want = customers.cohort_drill_down(retention, str(month), k).collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert spark.sql("SELECT * FROM cohort_drill_down(DATE'1900-01-01', 5)").count() == 0


def test_functions_compose(spark):
    functions.register_functions(spark, SF_SMALL)
    top = {r[0] for r in spark.sql("SELECT product_id FROM products_to_rank(7)").collect()}
    ranked = ALL_QUERIES["product_performance"](spark, SF_SMALL)
    assert top == {r[0] for r in ranked.where("item_revenue_rank <= 7").select("product_id").collect()} and len(top) >= 7
    assert spark.sql("SELECT count(*) FROM month_calendar(DATE'2016-11-30', DATE'2017-02-01')").first()[0] == 4
    assert spark.sql("SELECT * FROM month_calendar(DATE'2017-02-01', DATE'2017-01-01')").count() == 0
    rows = spark.sql("SELECT * FROM sales_between(DATE'1989-12-01', DATE'1990-01-15')").collect()
    assert [(str(r[0]), r[1], r[2]) for r in rows] == [("1989-12-01", 0, 0.0), ("1990-01-01", 0, 0.0)]
    # a lateral call takes a parameter from a row
    n = spark.sql("SELECT s, (SELECT count(*) FROM month_calendar(DATE'2017-01-01', s)) AS n FROM VALUES (DATE'2017-01-01'), (DATE'2017-03-01') AS t(s)").collect()
    assert sorted((str(r.s), r.n) for r in n) == [("2017-01-01", 1), ("2017-03-01", 3)]
