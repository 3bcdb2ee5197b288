"""Explicit schemas of the raw (as read) and clean layers.

Never infer schemas in production: ZIP codes would lose leading zeros and
review text with quoted newlines would split rows. The lists below are the
contract both for the CSV reader and for the profile reports' ``data_type``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RAW_COLUMNS: dict[str, list[tuple[str, str]]] = {
    "customers": [("customer_id", "string"), ("customer_unique_id", "string"), ("customer_zip_code_prefix", "int"), ("customer_city", "string"), ("customer_state", "string")],
    "geolocation": [("geolocation_zip_code_prefix", "int"), ("geolocation_lat", "double"), ("geolocation_lng", "double"), ("geolocation_city", "string"), ("geolocation_state", "string")],
    "order_items": [("order_id", "string"), ("order_item_id", "int"), ("product_id", "string"), ("seller_id", "string"), ("shipping_limit_date", "string"), ("price", "double"), ("freight_value", "double")],
    "payments": [("order_id", "string"), ("payment_sequential", "int"), ("payment_type", "string"), ("payment_installments", "int"), ("payment_value", "double")],
    "reviews": [("review_id", "string"), ("order_id", "string"), ("review_score", "int"), ("review_comment_title", "string"), ("review_comment_message", "string"), ("review_creation_date", "string"), ("review_answer_timestamp", "string")],
    "orders": [("order_id", "string"), ("customer_id", "string"), ("order_status", "string"), ("order_purchase_timestamp", "string"), ("order_approved_at", "string"), ("order_delivered_carrier_date", "string"), ("order_delivered_customer_date", "string"), ("order_estimated_delivery_date", "string")],
    "products": [("product_id", "string"), ("product_category_name", "string"), ("product_name_lenght", "double"), ("product_description_lenght", "double"), ("product_photos_qty", "double"), ("product_weight_g", "double"), ("product_length_cm", "double"), ("product_height_cm", "double"), ("product_width_cm", "double")],
    "sellers": [("seller_id", "string"), ("seller_zip_code_prefix", "int"), ("seller_city", "string"), ("seller_state", "string")],
    "category_translation": [("product_category_name", "string"), ("product_category_name_english", "string")],
}

CLEAN_COLUMNS: dict[str, list[tuple[str, str]]] = {
    "customers": [("customer_id", "string"), ("customer_unique_id", "string"), ("customer_zip_code_prefix", "string"), ("customer_city", "string"), ("customer_state", "string")],
    "geolocation": [("geolocation_zip_code_prefix", "string"), ("geolocation_lat", "double"), ("geolocation_lng", "double"), ("geolocation_city", "string"), ("geolocation_state", "string"), ("geolocation_observation_count", "int")],
    "order_items": [("order_id", "string"), ("order_item_id", "int"), ("product_id", "string"), ("seller_id", "string"), ("shipping_limit_date", "timestamp_ntz"), ("price", "decimal(12,2)"), ("freight_value", "decimal(12,2)")],
    "payments": [("order_id", "string"), ("payment_sequential", "int"), ("payment_type", "string"), ("payment_installments", "int"), ("payment_value", "decimal(12,2)")],
    "reviews": [("review_id", "string"), ("order_id", "string"), ("review_score", "smallint"), ("review_comment_title", "string"), ("review_comment_message", "string"), ("review_creation_date", "timestamp_ntz"), ("review_answer_timestamp", "timestamp_ntz")],
    "orders": [("order_id", "string"), ("customer_id", "string"), ("order_status", "string"), ("order_purchase_timestamp", "timestamp_ntz"), ("order_approved_at", "timestamp_ntz"), ("order_delivered_carrier_date", "timestamp_ntz"), ("order_delivered_customer_date", "timestamp_ntz"), ("order_estimated_delivery_date", "timestamp_ntz"), ("has_timestamp_anomaly", "boolean"), ("has_status_date_mismatch", "boolean"), ("is_valid_delivery_record", "boolean")],
    "products": [("product_id", "string"), ("product_category_name", "string"), ("product_name_lenght", "double"), ("product_description_lenght", "double"), ("product_photos_qty", "double"), ("product_weight_g", "double"), ("product_length_cm", "double"), ("product_height_cm", "double"), ("product_width_cm", "double"), ("product_category_name_english", "string")],
    "sellers": [("seller_id", "string"), ("seller_zip_code_prefix", "string"), ("seller_city", "string"), ("seller_state", "string")],
    "category_translation": [("product_category_name", "string"), ("product_category_name_english", "string")],
}

def struct(columns: list[tuple[str, str]]) -> StructType:
    return StructType.fromDDL(", ".join(f"{n} {t}" for n, t in columns))


def conform(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Select the contract columns in order, cast to the contract types."""
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in columns])
