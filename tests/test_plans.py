"""Plan assertions: no Python UDFs, filters reach the parquet scan, named views work."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from marketlens.plans.registry import register_views

QUERIES = E.queries()


@pytest.mark.parametrize("name", ["order_summary", "customer_rfm", "product_performance", "seller_risk", "monthly_sales", "clean_geolocation"])
def test_no_python_udf(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in plan


def test_completed_filter_pushed_to_model_scan(spark):
    plan = QUERIES["sales_kpis"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(order_status), EqualTo(order_status,delivered), IsNotNull(payment_value_total)]" in plan


def test_column_pruning_on_model_scan(spark):
    plan = QUERIES["late_rate"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # only the two needed columns of the 51-column order model are read
    assert "ReadSchema: struct<is_late_delivery:boolean,is_valid_delivery_record:boolean>" in plan


def test_register_views(spark):
    names = register_views(spark, SF_SMALL, ["monthly_sales", "late_rate"])
    assert names == ["v_monthly_sales", "v_late_rate"]
    assert spark.sql("SELECT COUNT(*) FROM v_monthly_sales").first()[0] > 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_landed_tables_join_without_exchange_and_go_at_the_end(spark):
    """Tables landed in buckets of the order: neither V02-V05, V25 nor the joins of V06 on the order deal rows anew. ``close``
    drops the tables."""
    from marketlens.operators import model, operations
    from marketlens.plans.catalog import Marketplace

    m = Marketplace(spark, SF_SMALL)
    c = m.clean
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        assert "Exchange" not in _plan(model.order_summary(c["orders"], m.order_customers, c["order_items"], c["payments"], c["reviews"]))
        assert "Exchange" not in _plan(operations.seller_order_performance(m.order_item_detail, m.order_summary))
        detail = _plan(model.order_item_detail(c["order_items"], c["orders"], m.order_customers, c["products"], c["sellers"]))
        assert "hashpartitioning(order_id" not in detail
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    names = list(m._tables)
    assert names and all(spark.catalog.tableExists(n) for n in names)
    m.close()
    assert not any(spark.catalog.tableExists(n) for n in names)
