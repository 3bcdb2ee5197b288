"""What lies on the disks at once: shuffle files of finished steps, cached frames, pairs and slices."""

import os

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from marketlens.functions.exprs import distinct_counts
from marketlens.operators import digests, model, operations
from marketlens.plans import refresh
from marketlens.plans.catalog import Marketplace, marketplace
from marketlens.plans.registry import ALL_QUERIES, Views, views
from marketlens.session import _CLEANUP, shuffles_deleted


def _shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _ids(files):
    return {f.split("_")[1] for f in files}


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    spark.sparkContext._jvm.System.gc()
    before = _ids(_shuffle_files(spark))
    with shuffles_deleted(spark):
        with shuffles_deleted(spark):
            pass
        assert spark.conf.get(_CLEANUP) == "true"
        spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(str(tmp_path / "a"))
        spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().checkpoint()
    assert spark.conf.get(_CLEANUP) == "false"
    assert not _ids(_shuffle_files(spark)) - before


def test_a_failed_block_restores_the_setting(spark):
    with pytest.raises(ValueError):
        with shuffles_deleted(spark):
            raise ValueError
    assert spark.conf.get(_CLEANUP) == "false"


def test_landing_and_models_leave_no_shuffle_files(spark, tmp_path):
    """A report over layers that nobody has landed yet."""
    os.symlink(SF_SMALL, tmp_path / "tables")
    root = str(tmp_path / "tables")
    before = _ids(_shuffle_files(spark))
    df = ALL_QUERIES["category_items_all"](spark, root)
    assert not _ids(_shuffle_files(spark)) - before
    first = df.collect()
    assert first == df.collect() and len(first) > 1
    marketplace(spark, root).close()


def test_seller_orders_are_not_cached(spark):
    v = views(spark, SF_SMALL)
    assert not v.seller_orders().storageLevel.useDisk
    assert "InMemoryTableScan" not in _plan(v.seller_orders())


def test_sellers_land_no_items(spark):
    m = Marketplace(spark, SF_SMALL)
    v = Views(m)
    rows = sorted(v.sellers().collect())
    assert rows and "completed_items" not in m.__dict__
    landed = operations.seller_performance(v.seller_orders(), m.completed_items)
    assert sorted(landed.collect()) == rows and m.items_of_sellers() is m.completed_items
    m.close()


def test_sellers_customers_months_and_states(spark):
    """Distinct customers counted apart from the sums, also of a NULL seller and a NULL state."""
    v = views(spark, SF_SMALL)
    hidden = F.when(F.col("seller_id") != "1", F.col("seller_id")).alias("seller_id")
    orders = v.seller_orders()
    orders = orders.select(*[hidden if c == "seller_id" else F.col(c) for c in orders.columns])
    got = {r.seller_id: r.customer_count for r in operations.seller_performance(orders, v.m.completed_items).collect()}
    assert got == {r[0]: r[1] for r in orders.groupBy("seller_id").agg(F.count_distinct("customer_unique_id")).collect()} and got[None]
    summary = v.os.withColumn("customer_state", F.when(F.col("customer_state") != "CHINA", F.col("customer_state")))
    states = operations.state_delivery(summary)
    assert states.columns[:3] == ["customer_state", "completed_order_count", "customer_count"]
    done = summary.where("order_status = 'delivered' and payment_value_total is not null").withColumn("s", F.coalesce("customer_state", F.lit("unknown")))
    assert {r[0]: r[2] for r in states.collect()} == {r[0]: r[1] for r in done.groupBy("s").agg(F.count_distinct("customer_unique_id")).collect()}
    # no wide row goes with a pair of state and customer
    assert "partial_count(distinct" not in _plan(states)


def test_distinct_counts_in_turn(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 1, None), ("a", 2, "x"), ("b", None, None)], "k string, n int, s string")
    apart = distinct_counts(t, ["k"], {"n_n": "n", "n_s": "s"}, in_turn=True)
    assert sorted(map(tuple, apart.collect())) == [("a", 2, 1), ("b", 0, 0)]
    assert "HashAggregate" not in _plan(apart)


def test_items_are_not_dealt_by_product_or_seller(spark):
    m = marketplace(spark, SF_SMALL)
    c = m.clean
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with dimensions above it
    try:
        plan = _plan(model.order_item_detail(c["order_items"], c["orders"], m.order_customers, *m.dimensions))
        assert "hashpartitioning(product_id" not in plan and "hashpartitioning(seller_id" not in plan
        # nor by customer, whose join takes orders only
        plan = _plan(refresh._models(c, m.dimensions)["order_item_detail"])
        dealt = plan.split("hashpartitioning(customer_id")[1].splitlines()
        assert not any("shipping_limit_date" in line for line in dealt[:2])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_inventory_counts_rows_only(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "n int, s string")
    assert [tuple(r) for r in digests.distinct_values({"t": t}, "rows").collect()] == [("t", "", 2)]
    assert sorted(map(tuple, digests.distinct_values({"t": t}, "columns").collect())) == [("t", "n", 2), ("t", "s", 1)]
    m = Marketplace(spark, SF_SMALL)
    assert m.metrics("raw")["orders"]["rows"] and "clean" not in m.__dict__
    assert m.distinct_rows.count() == len(m.raw) and m.distinct_values.where("column_name = ''").count() == 0
    m.close()


def _slices_hold(clean, got):
    for name in refresh.MODELS:
        want = refresh._models(clean)[name].select(*got[name].columns)
        assert got[name].exceptAll(want).isEmpty() and want.exceptAll(got[name]).isEmpty(), name


def test_refresh_in_slices(spark, tmp_path, monkeypatch):
    c = dict(marketplace(spark, SF_SMALL).clean)
    some = c["orders"].where("abs(hash(order_id)) % 9 = 0").select("order_id").persist()
    for t in ("orders", "order_items", "payments", "reviews"):
        c[t] = c[t].join(some, "order_id", "left_semi").persist()
    monkeypatch.setattr(refresh, "SLICE_ROWS", 60)
    monkeypatch.setattr(refresh, "SLICES", 3)
    _slices_hold(c, refresh.refreshed(c, str(tmp_path / "refreshed")))
    nobody = c["orders"].limit(1).withColumns({"order_id": F.lit(None).cast("string"), "order_purchase_timestamp": F.lit(None).cast("timestamp_ntz")})
    c["orders"] = c["orders"].unionByName(nobody).persist()
    written, write = [], refresh._write
    monkeypatch.setattr(refresh, "_write", lambda df, path, mode: (written.append((path.rpartition("/")[2], mode)), write(df, path, mode)))
    _slices_hold(c, refresh.build(c, str(tmp_path / "built")))
    assert sorted(written) == sorted((name, mode) for name in refresh.MODELS for mode in ("static", "append", "append"))
    rows = [refresh.Row(purchase_month=m, changed=1, left=n) for m, n in ((None, 100), (1, 50), (2, 40), (3, 5), (3, 3))]
    assert sorted(map(len, refresh._groups(rows))) == [1, 1, 2] and set().union(*refresh._groups(rows)) == {None, 1, 2, 3}
    assert refresh._groups([]) == []
