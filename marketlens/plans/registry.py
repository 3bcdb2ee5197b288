"""Query registry: every composite operator as ``(spark, sf_dir) -> DataFrame``.

Results pass through :func:`finish` (exact DECIMAL -> DOUBLE at the end only).
The analytic frames share one :class:`Marketplace` per (session, data root),
so V05/V06 are computed once and reused by every report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.functions.exprs import finish
from marketlens.operators import cleaning, customers, digests, fingerprints, model, observed, operations, quality, reports, rfm, sales, validation
from marketlens.sources import rejects
from marketlens.plans import refresh
from marketlens.plans.catalog import TEST_MANUAL_TRANSLATIONS, Marketplace, marketplace
from marketlens.session import shuffles_deleted
from marketlens.sources.testdata import HIGH_VALUE_RANK


class Views:
    """Lazily built analytic views over one Marketplace (each built once)."""

    def __init__(self, m: Marketplace):
        self.m = m
        self._memo = m.memo

    # Views read by several reports are kept (MEMORY_AND_DISK) once built. Not V25: it has nearly as many rows as there are
    # items, most of which would go to the disks, and comes from the models' buckets without an exchange.
    SHARED = {"cs", "act", "sets", "ms", "ret"}

    def _get(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._memo:
            df = build()
            if key in self.SHARED:
                df = self.m.keep(df)
            self._memo[key] = df
        return self._memo[key]

    @property
    def os(self) -> DataFrame:
        return self.m.order_summary

    @property
    def oid(self) -> DataFrame:
        return self.m.order_item_detail

    def t(self, name: str) -> DataFrame:
        return self.m.table(name)

    def customer_summary(self):
        return self._get("cs", lambda: customers.customer_summary(self.os))

    def activity(self):
        return self._get("act", lambda: customers.customer_monthly_activity(self.os))

    def month_sets(self):
        return self._get("sets", lambda: customers.month_sets(self.os))

    def monthly_metrics(self):
        return self._get("mcm", lambda: customers.monthly_customer_metrics(self.activity()))

    def retention(self):
        return self._get("ret", lambda: customers.cohort_retention(self.month_sets(), self.activity()))

    def rfm(self):
        return self._get("rfm", lambda: rfm.customer_rfm(self.os, self.customer_summary()))

    def segments(self):
        return self._get("seg", lambda: rfm.segment_summary(self.rfm()))

    def monthly_sales(self):
        return self._get("ms", lambda: sales.monthly_sales(self.os))

    def categories(self):
        return self._get("cat", lambda: sales.category_performance(self.m.completed_items))

    def products_ranked(self):
        return self._get("prk", lambda: sales.product_ranked(self.m.completed_items))

    def products(self):
        return self._get("pp", lambda: self.products_ranked().select(*sales.PRODUCT_COLUMNS))

    def refreshed(self):
        """The models of an earlier state, refreshed to the present one."""
        return self._get("refreshed", lambda: refresh.refreshed(self.m.clean, self.m.scratch("refreshed")))

    def seller_orders(self):
        return self._get("sop", lambda: operations.seller_order_performance(self.oid, self.os))

    def sellers(self):
        return self._get("sp", lambda: operations.seller_performance(self.seller_orders(), self.m.items_of_sellers()))

    def monthly_delivery(self):
        return self._get("mdp", lambda: operations.monthly_delivery(self.monthly_sales(), self.os))

    def state_delivery(self):
        return self._get("sdp", lambda: operations.state_delivery(self.os))

    def ops_kpis(self):
        return self._get("ok", lambda: operations.operations_kpis(self.os, self.seller_orders()))

    def impact(self):
        return self._get("dri", lambda: operations.delivery_review_impact(self.os))

    def risk(self):
        return self._get("risk", lambda: operations.seller_risk(self.sellers(), HIGH_VALUE_RANK))


def views(spark: SparkSession, sf_dir: str) -> Views:
    return Views(marketplace(spark, sf_dir))


def _q(fn: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with shuffles_deleted(spark):
            df = fn(views(spark, sf_dir))
        return finish(df)

    run.build = fn  # un-finished builder, used to derive the oracle's DOUBLE columns
    return run


ANALYTIC_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "order_items_agg": _q(lambda v: model.order_items_agg(v.t("order_items"))),
    "payments_agg": _q(lambda v: model.payments_agg(v.t("payments"))),
    "reviews_agg": _q(lambda v: model.reviews_agg(v.t("reviews"))),
    "order_summary": _q(lambda v: v.os),
    "order_item_detail": _q(lambda v: v.oid),
    "database_validation": _q(lambda v: validation.database_validation(raw=v.m.raw, clean=v.m.clean, manual_rows=len(TEST_MANUAL_TRANSLATIONS))),
    "model_validation": _q(
        lambda v: validation.model_validation(
            v.m.clean,
            v.os,
            v.oid,
            {
                "items": model.order_items_agg(v.t("order_items")),
                "payments": model.payments_agg(v.t("payments")),
                "reviews": model.reviews_agg(v.t("reviews")),
            },
        )
    ),
    "customer_summary": _q(lambda v: v.customer_summary()),
    "customer_monthly_activity": _q(lambda v: v.activity()),
    "monthly_customer_metrics": _q(lambda v: v.monthly_metrics()),
    "cohort_retention": _q(lambda v: v.retention()),
    "cohort_matrix_12m": _q(lambda v: customers.cohort_matrix_12m(v.retention())),
    "cohort_benchmark": _q(lambda v: customers.cohort_benchmark(v.retention())),
    "customer_rfm": _q(lambda v: v.rfm()),
    "segment_summary": _q(lambda v: v.segments()),
    "customer_validation": _q(
        lambda v: validation.customer_validation(
            v.m.clean, v.os, v.customer_summary(), v.activity(), v.monthly_metrics(), v.retention(), v.rfm(), v.segments()
        )
    ),
    "customer_kpis": _q(lambda v: rfm.customer_kpis(v.rfm())),
    "monthly_customer_growth": _q(lambda v: customers.monthly_customer_growth(v.monthly_metrics())),
    "monthly_sales": _q(lambda v: v.monthly_sales()),
    "category_performance": _q(lambda v: v.categories()),
    "product_performance": _q(lambda v: v.products()),
    "sales_kpis": _q(lambda v: sales.sales_kpis(v.os)),
    "revenue_concentration": _q(lambda v: sales.revenue_concentration(v.products_ranked())),
    "sales_validation": _q(lambda v: validation.sales_validation(v.os, v.monthly_sales(), v.categories(), v.products())),
    "seller_order_performance": _q(lambda v: v.seller_orders()),
    "seller_performance": _q(lambda v: v.sellers()),
    "monthly_delivery": _q(lambda v: v.monthly_delivery()),
    "state_delivery": _q(lambda v: v.state_delivery()),
    "operations_kpis": _q(lambda v: v.ops_kpis()),
    "delivery_review_impact": _q(lambda v: v.impact()),
    "seller_risk": _q(lambda v: v.risk()),
    "operations_validation": _q(
        lambda v: validation.operations_validation(
            v.os, v.monthly_delivery(), v.state_delivery(), v.ops_kpis(), v.impact(), v.sellers(), v.seller_orders()
        )
    ),
    "priority_sellers": _q(lambda v: operations.priority_sellers(v.risk())),
    "top_products": _q(lambda v: sales.top_products(v.products())),
    "risk_segment_summary": _q(lambda v: operations.risk_segment_summary(v.risk())),
    "monthly_order_performance": _q(lambda v: sales.monthly_order_performance(v.os)),
    "category_items_all": _q(lambda v: sales.category_items_all(v.oid)),
    "late_rate": _q(lambda v: operations.late_rate(v.os)),
}

def _std(v: Views) -> dict[str, DataFrame]:
    return v._get("std", lambda: cleaning.standardize(v.m.raw))


QUALITY_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_dates": _q(lambda v: cleaning.date_conversion_report(v.m.raw)),
    "clean_zip": _q(lambda v: cleaning.zip_report(v.m.raw)),
    "clean_text": _q(lambda v: cleaning.text_report(cleaning.dates_and_zips(v.m.raw))),
    "clean_categories": _q(
        lambda v: cleaning.category_report(_std(v)["products"], _std(v)["category_translation"], TEST_MANUAL_TRANSLATIONS)
    ),
    "untranslated_categories": _q(lambda v: cleaning.untranslated_categories(_std(v)["products"], _std(v)["category_translation"])),
    "clean_geolocation": _q(lambda v: cleaning.geolocation_report(v.m.raw["geolocation"], v.t("geolocation"))),
    "zip_coverage": _q(lambda v: cleaning.zip_coverage(v.t("customers"), v.t("sellers"), v.t("geolocation"))),
    "order_timestamp_checks": _q(lambda v: cleaning.order_timestamp_checks(v.t("orders"))),
    "order_flags": _q(
        lambda v: v.t("orders").select(
            "order_id", "order_status", "has_timestamp_anomaly", "has_status_date_mismatch", "is_valid_delivery_record"
        )
    ),
    "status_counts": _q(lambda v: quality.status_counts(v.t("orders"))),
    "numeric_profile": _q(lambda v: quality.numeric_profile(v.m.raw)),
    "business_rules": _q(lambda v: quality.business_rules(v.m.raw)),
    "constraint_checks": _q(lambda v: quality.constraint_checks(v.m.clean)),
    "invalid_rows": _q(lambda v: quality.invalid_rows(v.m.raw)),
    "numeric_treatment": _q(lambda v: quality.treatment_summary(v.m.raw, v.t("orders"))),
    "final_key_checks": _q(lambda v: quality.final_key_checks(v.m.clean)),
    "key_checks": _q(lambda v: quality.key_checks(v.m.raw)),
    "foreign_key_checks": _q(lambda v: quality.foreign_key_checks(v.m.raw)),
    "schema_overview": _q(lambda v: digests.schema_overview(v.m.raw, v.m.metrics("raw"), v.m.distinct_values)),
    "data_type_checks": _q(lambda v: observed.data_type_checks(v.m.clean, v.m.metrics("clean"))),
    "dataset_inventory": _q(lambda v: digests.dataset_inventory(v.m.raw, v.m.metrics("raw"), v.m.distinct_rows)),
    "cleaning_summary": _q(lambda v: observed.cleaning_summary(v.m.spark, v.m.metrics("raw"), v.m.metrics("clean"))),
    "table_row_counts": _q(lambda v: observed.table_row_counts(v.m.spark, v.m.metrics("clean"))),
    "final_assertions": _q(lambda v: observed.final_assertions(v.m.metrics("raw"), v.m.metrics("clean"), v.t("geolocation"))),
    "model_profile": _q(lambda v: validation.model_profile(v.os)),
    "rejected_payments": _q(lambda v: rejects.rejected_payments(v.m.raw["payments"], v.m.scratch("rejects"))),
    "refreshed_order_summary": _q(lambda v: v.refreshed()["order_summary"]),
    "refreshed_item_detail": _q(lambda v: v.refreshed()["order_item_detail"]),
    "model_fingerprints": _q(lambda v: fingerprints.compare(fingerprints.model_pairs(v.m.clean, v.os, v.oid, v.activity()))[0]),
    "share_checks": _q(lambda v: validation.share_checks(v.categories(), v.products(), v.sellers())),
}

REPORT_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "peak_month": _q(lambda v: reports.peak_month(v.monthly_sales())),
    "growth_sign": _q(lambda v: reports.growth_sign(customers.monthly_customer_growth(v.monthly_metrics()))),
    "retention_heatmap_frame": _q(lambda v: reports.retention_heatmap_frame(customers.cohort_matrix_12m(v.retention()))),
    "segment_distribution": _q(lambda v: reports.segment_distribution(v.segments())),
    "top_categories_frame": _q(lambda v: reports.top_categories_frame(v.categories())),
    "delivery_comparison": _q(lambda v: reports.delivery_comparison(v.impact())),
    "state_scatter_frame": _q(lambda v: reports.state_scatter_frame(v.state_delivery(), v.ops_kpis())),
    "risk_summary_frame": _q(lambda v: reports.risk_summary_frame(v.risk())),
}

LIST_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "preview_products": _q(lambda v: sales.preview_products(v.products())),
    "top_sellers": _q(lambda v: operations.top_sellers(v.sellers())),
    "recent_delivery": _q(lambda v: operations.recent_delivery(v.monthly_delivery())),
    "states_by_late_rate": _q(lambda v: operations.states_by_late_rate(v.state_delivery())),
    "customer_profile": _q(lambda v: customers.customer_profile(v.customer_summary())),
    "monthly_profile": _q(lambda v: customers.monthly_profile(v.monthly_metrics())),
    "recent_activity": _q(lambda v: customers.recent_activity(v.monthly_metrics())),
    "top_activity_months": _q(lambda v: customers.top_activity_months(customers.monthly_customer_growth(v.monthly_metrics()))),
    "cohort_drill_down": _q(lambda v: customers.cohort_drill_down(v.retention())),
    "database_check_totals": _q(lambda v: quality.check_totals(validation.database_validation(raw=v.m.raw, clean=v.m.clean, manual_rows=len(TEST_MANUAL_TRANSLATIONS)))),
}

def _call(name: str, *arguments: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from marketlens.plans.functions import call  # it makes its functions over the views of this module

        return finish(call(spark, sf_dir, name, *arguments))

    return run


FUNCTION_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "function_cohort_drill_down": _call("cohort_drill_down", "DATE'2017-01-01'", "13"),
    "function_products_to_rank": _call("products_to_rank", "25"),
    "function_sales_between": _call("sales_between", "DATE'2017-03-15'", "DATE'2018-02-01'"),
}

ALL_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **ANALYTIC_QUERIES, **QUALITY_QUERIES, **REPORT_QUERIES, **LIST_QUERIES, **FUNCTION_QUERIES
}


def register_views(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> list[str]:
    """Expose every query as a named temp view for SQL users. Reports run when the view is read; the landed
    layers and the global rankings below them are made once, when the view is registered."""
    out = []
    for name in names or list(ALL_QUERIES):
        ALL_QUERIES[name](spark, sf_dir).createOrReplaceTempView(f"v_{name}")
        out.append(f"v_{name}")
    return out
