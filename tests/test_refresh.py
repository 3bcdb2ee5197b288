"""A refresh of the models from changed orders equals a full build, and leaves other months alone."""

import os

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from marketlens.plans import refresh
from marketlens.plans.catalog import marketplace


@pytest.fixture(scope="module")
def clean(spark):
    """A few hundred orders and their children, from the landed tables."""
    c = dict(marketplace(spark, SF_SMALL).clean)
    some = c["orders"].where("abs(hash(order_id)) % 5 = 0").select("order_id").persist()
    for t in ("orders", "order_items", "payments", "reviews"):
        c[t] = c[t].join(some, "order_id", "left_semi").persist()
    return c


def _same(got, want):
    for name in refresh.MODELS:
        a, b = got[name], want[name].select(*got[name].columns)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


def test_refresh_equals_a_full_build(clean, tmp_path):
    """Inserted, moved, re-dated and deleted orders, late reviews and payments."""
    got = refresh.refreshed(clean, str(tmp_path))
    assert got["order_summary"].count() > 100
    _same(got, refresh._models(clean))


def test_only_touched_months_are_written(spark, clean, tmp_path):
    base = str(tmp_path / "models")
    made = refresh.build(clean, base)
    files = lambda: {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(base) for f in names if f.startswith("part")}
    before = files()
    order = clean["orders"].where("order_purchase_timestamp is not null").orderBy("order_id").first()
    new = dict(clean)
    new["reviews"] = clean["reviews"].where(F.col("order_id") != order.order_id).unionByName(clean["reviews"].limit(1).withColumns({"order_id": F.lit(order.order_id), "review_id": F.lit("late")}))
    changed = refresh.changed_orders(clean, new)
    assert [r[0] for r in changed.collect()] == [order.order_id]
    months = refresh.refresh(new, changed, base, str(tmp_path))
    assert len(months) == 1
    kept = set(before) & set(files())
    assert len(before) - len(kept) <= 2 and all(files()[f] == before[f] for f in kept)
    _same(refresh.read_models(spark, base, made), refresh._models(new))


def test_a_month_that_loses_its_last_order_goes(spark, clean, tmp_path):
    base = str(tmp_path / "models")
    made = refresh.build(clean, base)
    month = made["order_summary"].groupBy("purchase_month").count().orderBy("count", "purchase_month").first()[0]
    new = dict(clean)
    new["orders"] = clean["orders"].where(F.trunc("order_purchase_timestamp", "month") != F.lit(month))
    for t in ("order_items", "payments", "reviews"):
        new[t] = clean[t].join(new["orders"].select("order_id"), "order_id", "left_semi")
    assert refresh.refresh(new, refresh.changed_orders(clean, new), base, str(tmp_path)) == [month]
    assert not os.path.exists(f"{base}/order_summary/purchase_month={month}")
    _same(refresh.read_models(spark, base, made), refresh._models(new))


def test_changed_customers_and_products_reach_their_orders(clean):
    new = dict(clean)
    order = clean["orders"].orderBy("order_id").first()
    item = clean["order_items"].orderBy(F.desc("order_id")).first()
    new["customers"] = clean["customers"].withColumn("customer_city", F.when(F.col("customer_id") == order.customer_id, F.lit("elsewhere")).otherwise(F.col("customer_city")))
    new["products"] = clean["products"].withColumn("product_category_name", F.when(F.col("product_id") == item.product_id, F.lit("other")).otherwise(F.col("product_category_name")))
    changed = {r[0] for r in refresh.changed_orders(clean, new).collect()}
    holding = {r[0] for r in clean["order_items"].where(F.col("product_id") == item.product_id).select("order_id").collect()}
    owned = {r[0] for r in clean["orders"].where(F.col("customer_id") == order.customer_id).select("order_id").collect()}
    assert changed == holding | owned


def test_nothing_changed(clean, tmp_path):
    base = str(tmp_path / "models")
    refresh.build(clean, base)
    assert refresh.refresh(clean, refresh.changed_orders(clean, clean), base, str(tmp_path)) == []


def test_a_refresh_writes_each_month_once(clean, tmp_path, monkeypatch):
    """The months go straight to their folder, which is read by the same job; nothing else holds whole months."""
    base, deleted = str(tmp_path / "models"), []
    refresh.build(clean, base)
    new = dict(clean)
    new["reviews"] = clean["reviews"].limit(0)
    monkeypatch.setattr(refresh, "_delete", lambda spark, path: deleted.append(path))
    assert refresh.refresh(new, refresh.changed_orders(clean, new), base, str(tmp_path))
    assert sorted(os.listdir(deleted[-1])) == ["changed", *sorted(refresh.MODELS)]
    _same(refresh.read_models(clean["orders"].sparkSession, base, refresh._models(clean)), refresh._models(new))
