"""Sources and sinks.

* ``read_raw_csv``: the nine raw CSV files with explicit schemas; only reviews hold quoted line breaks, so
  only they are read with ``multiLine`` (such a file can't be split) (S1).
* ``write_layer`` / ``read_layer``: a cleaned layer as Parquet (S4), the hand-off point that cuts lineage
  between cleaning and analytics; ``read_clean_csv`` loads clean CSV files typed and fails on the first
  bad row (S3).
* ``REPORTS`` / ``export_report``: the report exports with their orders (S5-S7). Reports that stay small by
  construction are one file; those that grow with sellers are range-sorted part files, written in parallel.
* ``read_report`` re-reads one with typed dates (S8).
* ``table_row_counts``: the per-table row-count listing (S15); ``file_inventory``: files and sizes (S2).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources.schemas import CLEAN_COLUMNS, RAW_COLUMNS, struct

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
#: Tables whose text may hold line breaks inside quotes.
MULTI_LINE = {"reviews"}


@dataclass(frozen=True)
class Report:
    """An export: its query, its order (column, descending), the row limit, and whether it grows with the data."""

    query: str
    order: tuple[tuple[str, bool], ...] = ()
    grows: bool = False


#: Names, contents and orders of the report files.
REPORTS: dict[str, Report] = {
    "database_validation": Report("database_validation", (("check_name", False),)),
    "analytics_model_validation": Report("model_validation", (("check_name", False),)),
    "monthly_customer_metrics": Report("monthly_customer_metrics", (("activity_month", False),)),
    "customer_cohort_retention": Report("cohort_retention", (("cohort_month", False), ("months_since_first_order", False))),
    "cohort_retention_matrix_12m": Report("cohort_matrix_12m", (("cohort_month", False),)),
    "customer_segment_summary": Report("segment_summary", (("monetary_value", True),)),
    "customer_analytics_validation": Report("customer_validation", (("check_name", False),)),
    "customer_kpi_summary": Report("customer_kpis"),
    "monthly_customer_growth": Report("monthly_customer_growth", (("activity_month", False),)),
    "cohort_retention_benchmark": Report("cohort_benchmark", (("months_since_first_order", False),)),
    "overall_sales_kpis": Report("sales_kpis"),
    "monthly_sales_metrics": Report("monthly_sales", (("sales_month", False),)),
    "category_performance": Report("category_performance", (("item_price_total", True),)),
    "top_products": Report("top_products", (("item_price_total", True), ("product_id", False))),
    "product_revenue_concentration": Report("revenue_concentration", (("threshold_pct", False),)),
    "sales_analysis_validation": Report("sales_validation", (("metric_name", False),)),
    "overall_operations_kpis": Report("operations_kpis"),
    "monthly_delivery_performance": Report("monthly_delivery", (("purchase_month", False),)),
    "state_delivery_performance": Report("state_delivery", (("completed_order_count", True),)),
    "seller_performance": Report("seller_performance", (("item_price_total", True), ("seller_id", False)), grows=True),
    "priority_sellers": Report(
        "priority_sellers", (("is_high_value_seller", True), ("operational_risk_score", True), ("item_price_total", True), ("seller_id", False)), grows=True
    ),
    "delivery_review_impact": Report("delivery_review_impact", (("delivery_status", False),)),
    "operations_validation": Report("operations_validation", (("metric_name", False),)),
}


def _csv(spark: SparkSession, table: str, columns: list[tuple[str, str]], mode: str):
    reader = spark.read.schema(struct(columns)).option("header", True).option("escape", '"').option("encoding", "UTF-8").option("mode", mode)
    return reader.option("multiLine", table in MULTI_LINE).option("timestampFormat", TS_FORMAT).option("timestampNTZFormat", TS_FORMAT)


def read_raw_csv(spark: SparkSession, paths: dict[str, str], mode: str = "PERMISSIVE") -> dict[str, DataFrame]:
    """Read each raw table with its explicit schema (timestamps stay text for C1)."""
    return {table: _csv(spark, table, RAW_COLUMNS[table], mode).csv(path) for table, path in paths.items()}


def read_clean_csv(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Load clean CSV files with the clean layer's types; a value that does not fit its type fails the load."""
    return {table: _csv(spark, table, CLEAN_COLUMNS[table], "FAILFAST").csv(path) for table, path in paths.items()}


def write_layer(frames: dict[str, DataFrame], base: str, fmt: str = "parquet") -> None:
    """Write every table of a layer under ``base/<table>``; CSV keeps the text timestamp format."""
    for table, df in frames.items():
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w = w.option("header", True).option("escape", '"').option("timestampFormat", TS_FORMAT).option("timestampNTZFormat", TS_FORMAT)
        w.format(fmt).save(f"{base}/{table}")


def read_layer(spark: SparkSession, base: str, tables: list[str]) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{base}/{t}") for t in tables}


def export_report(df: DataFrame, path: str, order: list[Column] | None = None, limit: int | None = None, grows: bool = False) -> None:
    """``\\copy (SELECT ... ORDER BY ... [LIMIT n]) TO csv HEADER``. A report that grows with the data keeps the
    sort's range partitions as part files, in order of their names."""
    if order:
        df = df.orderBy(*order)
    if limit is not None:
        df = df.limit(limit)  # top-k export: TakeOrderedAndProject
    if not grows:
        df = df.coalesce(1)
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", TS_FORMAT).csv(path)


def export_reports(frames: dict[str, DataFrame], base: str) -> list[str]:
    """Write the catalogued reports for the query results in ``frames`` (by query name); the report names written."""
    done = []
    for name, report in REPORTS.items():
        if report.query in frames:
            order = [F.col(c).desc() if descending else F.col(c).asc() for c, descending in report.order]
            export_report(frames[report.query], f"{base}/{name}", order, grows=report.grows)
            done.append(name)
    return done


def read_report(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Re-read an exported report with typed columns (e.g. ``sales_month DATE``)."""
    return spark.read.schema(ddl).option("header", True).csv(path)


def table_row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count for every table, ordered by name."""
    frames = dict(sorted(frames.items()))
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t, df in frames.items()]
    return reduce(DataFrame.unionByName, parts).orderBy("table_name")


def file_inventory(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per matching file with its size in MB (content column pruned, not read)."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
        F.round(F.col("length") / F.lit(1024 * 1024), 2).alias("file_size_mb"),
    )
