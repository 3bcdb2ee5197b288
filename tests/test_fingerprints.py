"""Fingerprints of row multisets: planted faults that keep all totals are found with their keys."""

from decimal import Decimal

import pytest
from conftest import SF_SMALL

from marketlens.operators import fingerprints as fp
from marketlens.plans.catalog import marketplace

SCHEMA = "order_id string, product_id string, price decimal(12,2)"


def _rows(n=400):
    return [(f"o{i % 150}", f"p{i % 31}", Decimal(i % 97)) for i in range(n)]


def _compare(spark, source, model):
    report, keys = fp.compare([fp.Pair("items", "order_id", spark.createDataFrame(source, SCHEMA), spark.createDataFrame(model, SCHEMA))])
    return tuple(report.first()), {tuple(r)[1:] for r in keys.collect()} if keys is not None else set()


def test_equal_multisets_in_another_order(spark):
    rows = [*_rows(), ("o1", "p1", None), ("o1", "p1", None), (None, None, Decimal(3))]
    assert _compare(spark, rows, rows[::-1]) == (("items", 403, 403, 0, True), set())


def test_a_swap_that_keeps_every_total(spark):
    """Two orders have exchanged prices: counts, sums and sums per product agree, the rows don't."""
    rows = _rows()
    swapped = list(rows)
    i, j = next((i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[1] == b[1] and a[0] != b[0] and a[2] != b[2])
    swapped[i], swapped[j] = (*rows[i][:2], rows[j][2]), (*rows[j][:2], rows[i][2])
    assert sum(r[2] for r in rows) == sum(r[2] for r in swapped)
    report, keys = _compare(spark, rows, swapped)
    assert report == ("items", 400, 400, 2, False) and {k[0] for k in keys} == {rows[i][0], rows[j][0]}


@pytest.mark.parametrize("fault", ["missing", "repeated", "null for zero"])
def test_other_faults(spark, fault):
    rows = [*_rows(), ("z", "p", Decimal(0))]
    model = {"missing": rows[:-1], "repeated": [*rows, rows[-1]], "null for zero": [*rows[:-1], ("z", "p", None)]}[fault]
    n = {"missing": 0, "repeated": 2, "null for zero": 1}[fault]
    report, keys = _compare(spark, rows, model)
    assert not report[4] and keys == {("z", 1, n)}


def test_values_are_not_run_together(spark):
    assert not _compare(spark, [("a", "bc", None)], [("a", "b", None)])[0][4]
    assert not _compare(spark, [("k", "1:", Decimal(1))], [("k", "1", Decimal(1))])[0][4]


def test_empty_sides(spark):
    assert _compare(spark, [], []) == (("items", 0, 0, 0, True), set())
    assert _compare(spark, [], [("a", "b", None)])[1] == {("a", 0, 1)}


def test_a_swap_planted_in_the_model(spark):
    from pyspark.sql import functions as F

    m = marketplace(spark, SF_SMALL)
    paid = m.order_summary.where("has_payment_record").orderBy("order_id").select("order_id", "payment_value_total").limit(50).collect()
    a = paid[0]
    b = next(r for r in paid if r.payment_value_total != a.payment_value_total)
    v = F.col("payment_value_total")
    wrong = m.order_summary.withColumn(
        "payment_value_total", F.when(F.col("order_id") == a.order_id, F.lit(b.payment_value_total)).when(F.col("order_id") == b.order_id, F.lit(a.payment_value_total)).otherwise(v)
    )
    pairs = [p for p in fp.model_pairs(m.clean, wrong, m.order_item_detail, _activity(m)) if p.name == "payment_totals_of_orders"]
    report, keys = fp.compare(pairs)
    assert report.first().differing_keys == 2 and {r.key for r in keys.collect()} == {a.order_id, b.order_id}


def _activity(m):
    from marketlens.operators.customers import customer_monthly_activity

    return customer_monthly_activity(m.order_summary)


def test_sums_are_longs_and_null_keys_are_compared(spark):
    """Digests are summed as LONGs, not as DECIMALs made of texts; rows without a key are a key of their own."""
    df = spark.createDataFrame(_rows(5), SCHEMA)
    assert {f.dataType.simpleString() for f in fp._sums(fp._limbs(df, "order_id"), "range").schema.fields if f.name != "range"} == {"bigint"}
    rows = [*_rows(), (None, "p", Decimal(1))]
    assert _compare(spark, rows, [*rows[:-1], (None, "p", Decimal(2))])[1] == {(None, 1, 1)}
    assert _compare(spark, rows, rows[:-1])[1] == {(None, 1, 0)}


def test_equal_values_have_equal_digests(spark):
    """One zero, whole numbers of any width, NULL apart from every value."""
    sums = lambda rows, schema: tuple(fp._sums(fp._limbs(spark.createDataFrame(rows, schema), "k")).first())
    assert sums([("a", 0.0, 1)], "k string, x double, n int") == sums([("a", -0.0, 1)], "k string, x double, n long")
    different = [sums([("a", *r)], "k string, x string, y string") for r in [(None, "b"), ("b", None), ("", "b"), ("b", ""), (None, None), ("", "")]]
    assert len(set(different)) == 6
