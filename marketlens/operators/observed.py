"""Metrics gathered by the pass that lands a layer.

``df.observe`` adds an aggregate to a write: its rows, the missing values of every column and the table's checks
come back with the write, so the row-count, type, summary and invariant reports need no scan of their own. The
same columns as one plain aggregate a table serve frames that aren't written (``measure``).

A metric is a number of one table and layer; there are as many as columns and checks, whatever the data, so they
are kept on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.exprs import count_if
from marketlens.operators.cleaning import DATE_COLUMNS, parse_timestamp

#: Metrics of one layer: table -> metric -> number. ``rows``, ``missing:<column>`` and the names of checks.
Metrics = dict[str, dict[str, int]]

FLAGS = ("has_timestamp_anomaly", "has_status_date_mismatch", "is_valid_delivery_record")
UNCHANGED = ("customers", "order_items", "payments", "reviews", "orders", "products", "sellers")


def _any_null(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def _unparsed(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() & parse_timestamp(c).isNull() for c in columns])


#: Checks of the raw and the clean layer: table -> name -> rows that fail.
RAW_CHECKS: dict[str, dict[str, Callable[[], Column]]] = {t: {"unparsed_dates": lambda c=c: _unparsed(c)} for t, c in DATE_COLUMNS.items()}
CLEAN_CHECKS: dict[str, dict[str, Callable[[], Column]]] = {
    "products": {
        "no_english_category": lambda: F.col("product_category_name_english").isNull(),
        "weight_not_positive": lambda: F.col("product_weight_g") <= 0,
    },
    "payments": {"installments_below_one": lambda: F.col("payment_installments") < 1},
    "orders": {"flag_missing": lambda: _any_null(FLAGS)},
}


def metric_columns(df: DataFrame, checks: dict[str, Callable[[], Column]]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("rows")]
    out += [count_if(F.col(f"`{c}`").isNull()).alias(f"missing:{c}") for c in df.columns]
    return out + [count_if(failing()).alias(name) for name, failing in checks.items()]


def observed(df: DataFrame, name: str, checks: dict[str, Callable[[], Column]]) -> tuple[DataFrame, Observation]:
    """``df`` with its metrics observed: ``get`` of the observation has them once the frame has been written."""
    observation = Observation(name)
    return df.observe(observation, *metric_columns(df, checks)), observation


def measure(frames: dict[str, DataFrame], checks: dict[str, dict[str, Callable[[], Column]]]) -> Metrics:
    """The metrics of frames that aren't written: one aggregate a table."""
    return {t: df.agg(*metric_columns(df, checks.get(t, {}))).first().asDict() for t, df in frames.items()}


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def table_row_counts(spark: SparkSession, clean: Metrics) -> DataFrame:
    """table_name, row_count for every table, ordered by name."""
    return _frame(spark, [(t, m["rows"]) for t, m in sorted(clean.items())], "table_name string, row_count long").orderBy("table_name")


def data_type_checks(clean: dict[str, DataFrame], metrics: Metrics) -> DataFrame:
    """C4: clean column types and missing values."""
    rows = [(t, f.name, f.dataType.simpleString(), metrics[t][f"missing:{f.name}"]) for t, df in clean.items() for f in df.schema.fields]
    spark = next(iter(clean.values())).sparkSession
    return _frame(spark, rows, "table_name string, column_name string, data_type string, missing_values long")


def cleaning_summary(spark: SparkSession, raw: Metrics, clean: Metrics) -> DataFrame:
    """C17: raw vs clean rows and columns per table."""
    columns = lambda m: sum(k.startswith("missing:") for k in m)
    rows = [(t, r["rows"], clean[t]["rows"], clean[t]["rows"] - r["rows"], columns(r), columns(clean[t])) for t, r in raw.items()]
    return _frame(spark, rows, "table_name string, raw_rows long, clean_rows long, row_change long, raw_columns long, clean_columns long")


def duplicate_zips(geolocation: DataFrame) -> DataFrame:
    """Rows of the clean geolocation beyond one a ZIP code, and a wrong number of columns. Distinct values can't be
    observed, so this one scans the ZIP codes."""
    wrong = F.lit(0 if len(geolocation.columns) == 6 else 1)
    return geolocation.agg((F.count(F.lit(1)) - F.count_distinct("geolocation_zip_code_prefix") + wrong).cast("long").alias("failing_rows"))


def final_assertions(raw: Metrics, clean: Metrics, geolocation: DataFrame) -> DataFrame:
    """The cleaning job's final invariants as (assertion, failing_rows, passed).

    The reference's fixed geolocation shape is re-aimed at its intent: one row per ZIP with six columns.
    """
    rows = [
        ("no_date_parse_failures", sum(m.get("unparsed_dates", 0) for m in raw.values())),
        ("every_product_has_english_category", clean["products"]["no_english_category"]),
        ("installments_at_least_one", clean["payments"]["installments_below_one"]),
        ("weights_positive_when_present", clean["products"]["weight_not_positive"]),
        ("order_flags_not_null", clean["orders"]["flag_missing"]),
        *[(f"row_count_unchanged_{t}", abs(raw[t]["rows"] - clean[t]["rows"])) for t in UNCHANGED],
    ]
    out = _frame(geolocation.sparkSession, rows, "assertion string, failing_rows long")
    zips = duplicate_zips(geolocation).select(F.lit("one_geolocation_row_per_zip").alias("assertion"), "failing_rows")
    return out.unionByName(zips).withColumn("passed", F.col("failing_rows") == 0)


def assert_clean(raw: Metrics, clean: Metrics, geolocation: DataFrame, known: frozenset[str] = frozenset()) -> None:
    """Raise when any final invariant fails but those in ``known`` (at most 13 check rows)."""
    failed: list[Row] = final_assertions(raw, clean, geolocation).where(~F.col("passed")).collect()
    bad = {r["assertion"] for r in failed} - known
    if bad:
        raise AssertionError(f"cleaning invariants failed: {sorted(bad)}")
