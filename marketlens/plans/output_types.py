"""Generated by tools/gen_output_types.py: the result type of every column of each query."""

OUTPUT_TYPES: dict[str, list[tuple[str, str]]] = {'business_rules': [('check_name', 'string'), ('affected_rows', 'bigint')],
 'category_items_all': [('product_category_name_english', 'string'),
                        ('item_count', 'bigint'),
                        ('product_revenue', 'double'),
                        ('freight_value', 'double')],
 'category_performance': [('product_category_name_english', 'string'),
                          ('order_count', 'bigint'),
                          ('item_count', 'bigint'),
                          ('product_count', 'bigint'),
                          ('seller_count', 'bigint'),
                          ('customer_count', 'bigint'),
                          ('item_price_total', 'double'),
                          ('freight_total', 'double'),
                          ('item_and_freight_total', 'double'),
                          ('average_item_price', 'double'),
                          ('average_items_per_order', 'double'),
                          ('freight_share_pct', 'double'),
                          ('item_revenue_share_pct', 'double'),
                          ('item_revenue_rank', 'bigint')],
 'clean_categories': [('metric', 'string'), ('value', 'bigint')],
 'clean_dates': [('table_name', 'string'),
                 ('column_name', 'string'),
                 ('missing_before', 'bigint'),
                 ('missing_after', 'bigint'),
                 ('parse_failures', 'bigint'),
                 ('minimum_date', 'timestamp_ntz'),
                 ('maximum_date', 'timestamp_ntz')],
 'clean_geolocation': [('metric', 'string'), ('value', 'bigint')],
 'clean_text': [('table_name', 'string'),
                ('column_name', 'string'),
                ('missing_before', 'bigint'),
                ('blank_strings_removed', 'bigint'),
                ('missing_after', 'bigint'),
                ('data_type_after', 'string')],
 'clean_zip': [('table_name', 'string'),
               ('column_name', 'string'),
               ('missing_values', 'bigint'),
               ('invalid_parse_values', 'bigint'),
               ('invalid_length_values', 'bigint')],
 'cleaning_summary': [('table_name', 'string'),
                      ('raw_rows', 'bigint'),
                      ('clean_rows', 'bigint'),
                      ('row_change', 'bigint'),
                      ('raw_columns', 'bigint'),
                      ('clean_columns', 'bigint')],
 'cohort_benchmark': [('months_since_first_order', 'bigint'),
                      ('observed_cohort_count', 'bigint'),
                      ('combined_cohort_size', 'bigint'),
                      ('active_customer_count', 'bigint'),
                      ('weighted_retention_rate_pct', 'double'),
                      ('average_cohort_retention_pct', 'double'),
                      ('minimum_cohort_retention_pct', 'double'),
                      ('maximum_cohort_retention_pct', 'double')],
 'cohort_drill_down': [('cohort_month', 'date'),
                       ('activity_month', 'date'),
                       ('months_since_first_order', 'bigint'),
                       ('cohort_size', 'bigint'),
                       ('active_customer_count', 'bigint'),
                       ('retention_rate_pct', 'double')],
 'cohort_matrix_12m': [('cohort_month', 'date'),
                       ('cohort_size', 'bigint'),
                       ('month_0', 'double'),
                       ('month_1', 'double'),
                       ('month_2', 'double'),
                       ('month_3', 'double'),
                       ('month_4', 'double'),
                       ('month_5', 'double'),
                       ('month_6', 'double'),
                       ('month_7', 'double'),
                       ('month_8', 'double'),
                       ('month_9', 'double'),
                       ('month_10', 'double'),
                       ('month_11', 'double'),
                       ('month_12', 'double')],
 'cohort_retention': [('cohort_month', 'date'),
                      ('activity_month', 'date'),
                      ('months_since_first_order', 'bigint'),
                      ('cohort_size', 'bigint'),
                      ('active_customer_count', 'bigint'),
                      ('inactive_customer_count', 'bigint'),
                      ('order_count', 'bigint'),
                      ('payment_value', 'double'),
                      ('retention_rate_pct', 'double'),
                      ('orders_per_active_customer', 'double'),
                      ('payment_per_active_customer', 'double')],
 'constraint_checks': [('table_name', 'string'), ('rule_name', 'string'), ('violating_rows', 'bigint')],
 'customer_kpis': [('total_customer_count', 'bigint'),
                   ('all_order_repeat_customer_count', 'bigint'),
                   ('all_order_repeat_customer_rate_pct', 'double'),
                   ('completed_purchase_customer_count', 'bigint'),
                   ('no_completed_purchase_customer_count', 'bigint'),
                   ('completed_repeat_customer_count', 'bigint'),
                   ('completed_repeat_customer_rate_pct', 'double'),
                   ('completed_order_count', 'bigint'),
                   ('completed_payment_value', 'double'),
                   ('average_completed_order_value', 'double'),
                   ('average_completed_customer_value', 'double'),
                   ('average_completed_orders_per_customer', 'double'),
                   ('analysis_reference_date', 'date')],
 'customer_monthly_activity': [('customer_unique_id', 'string'),
                               ('cohort_month', 'date'),
                               ('activity_month', 'date'),
                               ('months_since_first_order', 'bigint'),
                               ('is_new_customer', 'boolean'),
                               ('is_returning_customer', 'boolean'),
                               ('monthly_order_count', 'bigint'),
                               ('monthly_delivered_order_count', 'bigint'),
                               ('monthly_item_count', 'bigint'),
                               ('monthly_payment_value', 'double'),
                               ('monthly_average_order_payment', 'double')],
 'customer_profile': [('customer_count', 'bigint'),
                      ('unique_customer_count', 'bigint'),
                      ('reconstructed_order_count', 'bigint'),
                      ('repeat_customer_count', 'bigint'),
                      ('one_time_customer_count', 'bigint')],
 'customer_rfm': [('customer_unique_id', 'string'),
                  ('latest_customer_state', 'string'),
                  ('all_order_count', 'bigint'),
                  ('all_order_payment_value', 'double'),
                  ('is_repeat_customer', 'boolean'),
                  ('analysis_reference_date', 'date'),
                  ('first_completed_order_date', 'date'),
                  ('last_completed_order_date', 'date'),
                  ('recency_days', 'bigint'),
                  ('completed_order_count', 'bigint'),
                  ('monetary_value', 'double'),
                  ('average_completed_order_payment', 'double'),
                  ('recency_score', 'bigint'),
                  ('frequency_score', 'bigint'),
                  ('monetary_score', 'bigint'),
                  ('rfm_total_score', 'bigint'),
                  ('rfm_code', 'string'),
                  ('customer_segment', 'string')],
 'customer_summary': [('customer_unique_id', 'string'),
                      ('latest_zip_code_prefix', 'string'),
                      ('latest_customer_city', 'string'),
                      ('latest_customer_state', 'string'),
                      ('first_order_timestamp', 'timestamp_ntz'),
                      ('last_order_timestamp', 'timestamp_ntz'),
                      ('first_order_date', 'date'),
                      ('last_order_date', 'date'),
                      ('first_order_month', 'date'),
                      ('last_order_month', 'date'),
                      ('customer_relationship_days', 'bigint'),
                      ('order_count', 'bigint'),
                      ('delivered_order_count', 'bigint'),
                      ('canceled_order_count', 'bigint'),
                      ('paid_order_count', 'bigint'),
                      ('reviewed_order_count', 'bigint'),
                      ('valid_delivery_order_count', 'bigint'),
                      ('late_delivery_order_count', 'bigint'),
                      ('repeat_order_count', 'bigint'),
                      ('is_repeat_customer', 'boolean'),
                      ('total_item_count', 'bigint'),
                      ('total_product_value', 'double'),
                      ('total_freight_value', 'double'),
                      ('total_gross_item_value', 'double'),
                      ('total_payment_value', 'double'),
                      ('average_order_payment', 'double'),
                      ('average_items_per_order', 'double'),
                      ('average_review_score', 'double'),
                      ('average_delivery_days', 'double'),
                      ('late_delivery_rate_pct', 'double')],
 'customer_validation': [('check_name', 'string'),
                         ('actual_value', 'double'),
                         ('expected_value', 'double'),
                         ('status', 'string')],
 'data_type_checks': [('table_name', 'string'),
                      ('column_name', 'string'),
                      ('data_type', 'string'),
                      ('missing_values', 'bigint')],
 'database_check_totals': [('status', 'string'), ('check_count', 'bigint')],
 'database_validation': [('check_name', 'string'),
                         ('actual_value', 'double'),
                         ('expected_value', 'double'),
                         ('status', 'string')],
 'dataset_inventory': [('table_name', 'string'),
                       ('rows', 'bigint'),
                       ('columns', 'bigint'),
                       ('duplicate_rows', 'bigint'),
                       ('missing_cells', 'bigint')],
 'delivery_comparison': [('delivery_status', 'string'),
                         ('order_count', 'bigint'),
                         ('reviewed_order_count', 'bigint'),
                         ('average_delivery_days', 'double'),
                         ('average_delivery_delay_days', 'double'),
                         ('average_review_score', 'double'),
                         ('low_review_order_count', 'bigint'),
                         ('low_review_rate_pct', 'double'),
                         ('written_comment_order_count', 'bigint'),
                         ('written_comment_rate_pct', 'double'),
                         ('display_order', 'bigint')],
 'delivery_review_impact': [('delivery_status', 'string'),
                            ('order_count', 'bigint'),
                            ('reviewed_order_count', 'bigint'),
                            ('average_delivery_days', 'double'),
                            ('average_delivery_delay_days', 'double'),
                            ('average_review_score', 'double'),
                            ('low_review_order_count', 'bigint'),
                            ('low_review_rate_pct', 'double'),
                            ('written_comment_order_count', 'bigint'),
                            ('written_comment_rate_pct', 'double')],
 'final_assertions': [('assertion', 'string'), ('failing_rows', 'bigint'), ('passed', 'boolean')],
 'final_key_checks': [('table_name', 'string'),
                      ('key_columns', 'string'),
                      ('null_key_rows', 'bigint'),
                      ('duplicate_key_rows', 'bigint'),
                      ('key_valid', 'boolean')],
 'foreign_key_checks': [('relationship', 'string'),
                        ('child_rows', 'bigint'),
                        ('child_null_rows', 'bigint'),
                        ('orphan_rows', 'bigint'),
                        ('orphan_unique_values', 'bigint'),
                        ('coverage_pct', 'double'),
                        ('relationship_valid', 'boolean')],
 'function_cohort_drill_down': [('cohort_month', 'date'),
                                ('activity_month', 'date'),
                                ('months_since_first_order', 'bigint'),
                                ('cohort_size', 'bigint'),
                                ('active_customer_count', 'bigint'),
                                ('retention_rate_pct', 'double')],
 'function_products_to_rank': [('item_revenue_rank', 'bigint'),
                               ('product_id', 'string'),
                               ('item_price_total', 'double')],
 'function_sales_between': [('month', 'date'), ('order_count', 'bigint'), ('payment_value_total', 'double')],
 'growth_sign': [('activity_month', 'date'),
                 ('active_customer_count', 'bigint'),
                 ('active_customer_growth_pct', 'double'),
                 ('growth_direction', 'string')],
 'invalid_rows': [('table_name', 'string'), ('issue', 'string'), ('record_key', 'string'), ('value', 'double')],
 'key_checks': [('table_name', 'string'),
                ('candidate_key', 'string'),
                ('total_rows', 'bigint'),
                ('unique_combinations', 'bigint'),
                ('null_key_rows', 'bigint'),
                ('duplicate_key_rows', 'bigint'),
                ('is_valid_key', 'boolean'),
                ('expectation', 'string')],
 'late_rate': [('late_delivery_rate_pct', 'double')],
 'model_fingerprints': [('check_name', 'string'),
                        ('source_rows', 'bigint'),
                        ('model_rows', 'bigint'),
                        ('differing_keys', 'bigint'),
                        ('passed', 'boolean')],
 'model_profile': [('order_count', 'bigint'),
                   ('orders_without_items', 'bigint'),
                   ('orders_without_payments', 'bigint'),
                   ('orders_without_reviews', 'bigint'),
                   ('reconstructed_item_count', 'bigint'),
                   ('reconstructed_review_count', 'bigint')],
 'model_validation': [('check_name', 'string'),
                      ('actual_value', 'double'),
                      ('expected_value', 'double'),
                      ('status', 'string')],
 'monthly_customer_growth': [('activity_month', 'date'),
                             ('active_customer_count', 'bigint'),
                             ('new_customer_count', 'bigint'),
                             ('returning_customer_count', 'bigint'),
                             ('order_count', 'bigint'),
                             ('payment_value', 'double'),
                             ('previous_active_customer_count', 'bigint'),
                             ('previous_new_customer_count', 'bigint'),
                             ('previous_payment_value', 'double'),
                             ('active_customer_growth_pct', 'double'),
                             ('new_customer_growth_pct', 'double'),
                             ('payment_growth_pct', 'double')],
 'monthly_customer_metrics': [('activity_month', 'date'),
                              ('active_customer_count', 'bigint'),
                              ('new_customer_count', 'bigint'),
                              ('returning_customer_count', 'bigint'),
                              ('multi_order_customer_count', 'bigint'),
                              ('order_count', 'bigint'),
                              ('delivered_order_count', 'bigint'),
                              ('item_count', 'bigint'),
                              ('payment_value', 'double'),
                              ('average_payment_per_order', 'double'),
                              ('orders_per_active_customer', 'double'),
                              ('new_customer_rate_pct', 'double'),
                              ('returning_customer_rate_pct', 'double')],
 'monthly_delivery': [('purchase_month', 'date'),
                      ('completed_order_count', 'bigint'),
                      ('customer_count', 'bigint'),
                      ('payment_value_total', 'double'),
                      ('valid_delivery_order_count', 'bigint'),
                      ('late_delivery_order_count', 'bigint'),
                      ('late_delivery_rate_pct', 'double'),
                      ('average_delivery_days', 'double'),
                      ('average_estimated_delivery_days', 'double'),
                      ('average_carrier_handling_days', 'double'),
                      ('average_delivery_delay_days', 'double'),
                      ('average_delay_days_when_late', 'double'),
                      ('reviewed_order_count', 'bigint'),
                      ('average_review_score', 'double'),
                      ('low_review_order_count', 'bigint'),
                      ('low_review_rate_pct', 'double')],
 'monthly_order_performance': [('purchase_month', 'date'),
                               ('order_count', 'bigint'),
                               ('customer_count', 'bigint'),
                               ('total_payment_value', 'double')],
 'monthly_profile': [('month_count', 'bigint'),
                     ('first_activity_month', 'date'),
                     ('last_activity_month', 'date'),
                     ('reconstructed_customer_count', 'bigint'),
                     ('reconstructed_order_count', 'bigint')],
 'monthly_sales': [('sales_month', 'date'),
                   ('order_count', 'bigint'),
                   ('customer_count', 'bigint'),
                   ('item_count', 'bigint'),
                   ('item_price_total', 'double'),
                   ('freight_total', 'double'),
                   ('item_and_freight_total', 'double'),
                   ('payment_value_total', 'double'),
                   ('average_order_value', 'double'),
                   ('freight_share_pct', 'double'),
                   ('payment_difference', 'double'),
                   ('payment_growth_pct', 'double')],
 'numeric_profile': [('table_name', 'string'),
                     ('column_name', 'string'),
                     ('missing_values', 'bigint'),
                     ('negative_values', 'bigint'),
                     ('zero_values', 'bigint'),
                     ('minimum_value', 'double'),
                     ('maximum_value', 'double')],
 'numeric_treatment': [('table_name', 'string'),
                       ('issue', 'string'),
                       ('affected_rows', 'bigint'),
                       ('treatment', 'string')],
 'operations_kpis': [('completed_order_count', 'bigint'),
                     ('valid_delivery_order_count', 'bigint'),
                     ('late_delivery_order_count', 'bigint'),
                     ('late_delivery_rate_pct', 'double'),
                     ('average_delivery_days', 'double'),
                     ('average_estimated_delivery_days', 'double'),
                     ('average_carrier_handling_days', 'double'),
                     ('average_delivery_delay_days', 'double'),
                     ('average_delay_days_when_late', 'double'),
                     ('reviewed_order_count', 'bigint'),
                     ('average_review_score', 'double'),
                     ('low_review_order_count', 'bigint'),
                     ('low_review_rate_pct', 'double'),
                     ('seller_order_count', 'bigint'),
                     ('shipping_limit_breach_count', 'bigint'),
                     ('shipping_limit_breach_rate_pct', 'double'),
                     ('same_state_seller_order_count', 'bigint'),
                     ('same_state_delivery_rate_pct', 'double')],
 'operations_validation': [('metric_name', 'string'),
                           ('expected_value', 'double'),
                           ('actual_value', 'double'),
                           ('difference', 'double'),
                           ('passed', 'boolean')],
 'order_flags': [('order_id', 'string'),
                 ('order_status', 'string'),
                 ('has_timestamp_anomaly', 'boolean'),
                 ('has_status_date_mismatch', 'boolean'),
                 ('is_valid_delivery_record', 'boolean')],
 'order_item_detail': [('order_id', 'string'),
                       ('order_item_id', 'bigint'),
                       ('customer_id', 'string'),
                       ('customer_unique_id', 'string'),
                       ('customer_zip_code_prefix', 'string'),
                       ('customer_city', 'string'),
                       ('customer_state', 'string'),
                       ('order_status', 'string'),
                       ('order_purchase_timestamp', 'timestamp_ntz'),
                       ('purchase_date', 'date'),
                       ('purchase_month', 'date'),
                       ('purchase_year', 'bigint'),
                       ('product_id', 'string'),
                       ('product_category_name', 'string'),
                       ('product_category_name_english', 'string'),
                       ('seller_id', 'string'),
                       ('seller_zip_code_prefix', 'string'),
                       ('seller_city', 'string'),
                       ('seller_state', 'string'),
                       ('shipping_limit_date', 'timestamp_ntz'),
                       ('price', 'double'),
                       ('freight_value', 'double'),
                       ('gross_item_value', 'double'),
                       ('shipped_after_shipping_limit', 'boolean'),
                       ('delivery_days', 'bigint'),
                       ('delivery_delay_days', 'bigint'),
                       ('is_late_delivery', 'boolean'),
                       ('has_timestamp_anomaly', 'boolean'),
                       ('has_status_date_mismatch', 'boolean'),
                       ('is_valid_delivery_record', 'boolean')],
 'order_items_agg': [('order_id', 'string'),
                     ('item_count', 'bigint'),
                     ('distinct_product_count', 'bigint'),
                     ('seller_count', 'bigint'),
                     ('item_price_total', 'double'),
                     ('freight_total', 'double'),
                     ('gross_item_value', 'double')],
 'order_summary': [('order_id', 'string'),
                   ('customer_id', 'string'),
                   ('customer_unique_id', 'string'),
                   ('customer_zip_code_prefix', 'string'),
                   ('customer_city', 'string'),
                   ('customer_state', 'string'),
                   ('order_status', 'string'),
                   ('order_purchase_timestamp', 'timestamp_ntz'),
                   ('purchase_date', 'date'),
                   ('purchase_month', 'date'),
                   ('purchase_year', 'bigint'),
                   ('purchase_quarter', 'bigint'),
                   ('order_approved_at', 'timestamp_ntz'),
                   ('order_delivered_carrier_date', 'timestamp_ntz'),
                   ('order_delivered_customer_date', 'timestamp_ntz'),
                   ('order_estimated_delivery_date', 'timestamp_ntz'),
                   ('approval_hours', 'double'),
                   ('carrier_handling_days', 'bigint'),
                   ('delivery_days', 'bigint'),
                   ('estimated_delivery_days', 'bigint'),
                   ('delivery_delay_days', 'bigint'),
                   ('is_late_delivery', 'boolean'),
                   ('is_canceled', 'boolean'),
                   ('is_delivered', 'boolean'),
                   ('item_count', 'bigint'),
                   ('distinct_product_count', 'bigint'),
                   ('seller_count', 'bigint'),
                   ('item_price_total', 'double'),
                   ('freight_total', 'double'),
                   ('gross_item_value', 'double'),
                   ('payment_record_count', 'bigint'),
                   ('payment_type_count', 'bigint'),
                   ('payment_value_total', 'double'),
                   ('maximum_installments', 'bigint'),
                   ('payment_types', 'string'),
                   ('uses_credit_card', 'boolean'),
                   ('uses_voucher', 'boolean'),
                   ('review_record_count', 'bigint'),
                   ('average_review_score', 'double'),
                   ('minimum_review_score', 'bigint'),
                   ('maximum_review_score', 'bigint'),
                   ('first_review_date', 'timestamp_ntz'),
                   ('latest_review_answer', 'timestamp_ntz'),
                   ('has_written_comment', 'boolean'),
                   ('payment_difference', 'double'),
                   ('has_item_record', 'boolean'),
                   ('has_payment_record', 'boolean'),
                   ('has_review_record', 'boolean'),
                   ('has_timestamp_anomaly', 'boolean'),
                   ('has_status_date_mismatch', 'boolean'),
                   ('is_valid_delivery_record', 'boolean')],
 'order_timestamp_checks': [('check_name', 'string'), ('affected_rows', 'bigint')],
 'payments_agg': [('order_id', 'string'),
                  ('payment_record_count', 'bigint'),
                  ('payment_type_count', 'bigint'),
                  ('payment_value_total', 'double'),
                  ('maximum_installments', 'bigint'),
                  ('payment_types', 'string'),
                  ('uses_credit_card', 'boolean'),
                  ('uses_voucher', 'boolean')],
 'peak_month': [('peak_sales_month', 'date'),
                ('peak_payment_value', 'double'),
                ('peak_orders_month', 'date'),
                ('peak_order_count', 'bigint')],
 'preview_products': [('product_id', 'string'),
                      ('product_category_name_english', 'string'),
                      ('order_count', 'bigint'),
                      ('item_count', 'bigint'),
                      ('item_price_total', 'double'),
                      ('item_revenue_share_pct', 'double'),
                      ('cumulative_item_revenue_pct', 'double'),
                      ('item_revenue_rank', 'bigint')],
 'priority_sellers': [('seller_id', 'string'),
                      ('seller_city', 'string'),
                      ('seller_state', 'string'),
                      ('completed_order_count', 'bigint'),
                      ('customer_count', 'bigint'),
                      ('item_count', 'bigint'),
                      ('item_price_total', 'double'),
                      ('valid_delivery_order_count', 'bigint'),
                      ('late_delivery_rate_pct', 'double'),
                      ('average_delivery_days', 'double'),
                      ('shipping_limit_breach_rate_pct', 'double'),
                      ('reviewed_order_count', 'bigint'),
                      ('average_review_score', 'double'),
                      ('low_review_rate_pct', 'double'),
                      ('seller_revenue_rank', 'bigint'),
                      ('seller_revenue_share_pct', 'double'),
                      ('late_delivery_quartile', 'bigint'),
                      ('shipping_breach_quartile', 'bigint'),
                      ('low_review_quartile', 'bigint'),
                      ('operational_risk_score', 'bigint'),
                      ('is_high_value_seller', 'boolean'),
                      ('seller_risk_segment', 'string')],
 'product_performance': [('product_id', 'string'),
                         ('product_category_name_english', 'string'),
                         ('order_count', 'bigint'),
                         ('item_count', 'bigint'),
                         ('customer_count', 'bigint'),
                         ('seller_count', 'bigint'),
                         ('item_price_total', 'double'),
                         ('freight_total', 'double'),
                         ('average_item_price', 'double'),
                         ('minimum_item_price', 'double'),
                         ('maximum_item_price', 'double'),
                         ('first_purchase_date', 'date'),
                         ('last_purchase_date', 'date'),
                         ('item_revenue_rank', 'bigint'),
                         ('item_revenue_share_pct', 'double'),
                         ('cumulative_item_revenue_pct', 'double')],
 'recent_activity': [('activity_month', 'date'),
                     ('active_customer_count', 'bigint'),
                     ('new_customer_count', 'bigint'),
                     ('returning_customer_count', 'bigint'),
                     ('order_count', 'bigint'),
                     ('payment_value', 'double'),
                     ('returning_customer_rate_pct', 'double')],
 'recent_delivery': [('purchase_month', 'date'),
                     ('completed_order_count', 'bigint'),
                     ('late_delivery_rate_pct', 'double'),
                     ('average_delivery_days', 'double'),
                     ('average_delay_days_when_late', 'double'),
                     ('average_review_score', 'double'),
                     ('low_review_rate_pct', 'double')],
 'refreshed_item_detail': [('order_id', 'string'),
                           ('order_item_id', 'bigint'),
                           ('customer_id', 'string'),
                           ('customer_unique_id', 'string'),
                           ('customer_zip_code_prefix', 'string'),
                           ('customer_city', 'string'),
                           ('customer_state', 'string'),
                           ('order_status', 'string'),
                           ('order_purchase_timestamp', 'timestamp_ntz'),
                           ('purchase_date', 'date'),
                           ('purchase_month', 'date'),
                           ('purchase_year', 'bigint'),
                           ('product_id', 'string'),
                           ('product_category_name', 'string'),
                           ('product_category_name_english', 'string'),
                           ('seller_id', 'string'),
                           ('seller_zip_code_prefix', 'string'),
                           ('seller_city', 'string'),
                           ('seller_state', 'string'),
                           ('shipping_limit_date', 'timestamp_ntz'),
                           ('price', 'double'),
                           ('freight_value', 'double'),
                           ('gross_item_value', 'double'),
                           ('shipped_after_shipping_limit', 'boolean'),
                           ('delivery_days', 'bigint'),
                           ('delivery_delay_days', 'bigint'),
                           ('is_late_delivery', 'boolean'),
                           ('has_timestamp_anomaly', 'boolean'),
                           ('has_status_date_mismatch', 'boolean'),
                           ('is_valid_delivery_record', 'boolean')],
 'refreshed_order_summary': [('order_id', 'string'),
                             ('customer_id', 'string'),
                             ('customer_unique_id', 'string'),
                             ('customer_zip_code_prefix', 'string'),
                             ('customer_city', 'string'),
                             ('customer_state', 'string'),
                             ('order_status', 'string'),
                             ('order_purchase_timestamp', 'timestamp_ntz'),
                             ('purchase_date', 'date'),
                             ('purchase_month', 'date'),
                             ('purchase_year', 'bigint'),
                             ('purchase_quarter', 'bigint'),
                             ('order_approved_at', 'timestamp_ntz'),
                             ('order_delivered_carrier_date', 'timestamp_ntz'),
                             ('order_delivered_customer_date', 'timestamp_ntz'),
                             ('order_estimated_delivery_date', 'timestamp_ntz'),
                             ('approval_hours', 'double'),
                             ('carrier_handling_days', 'bigint'),
                             ('delivery_days', 'bigint'),
                             ('estimated_delivery_days', 'bigint'),
                             ('delivery_delay_days', 'bigint'),
                             ('is_late_delivery', 'boolean'),
                             ('is_canceled', 'boolean'),
                             ('is_delivered', 'boolean'),
                             ('item_count', 'bigint'),
                             ('distinct_product_count', 'bigint'),
                             ('seller_count', 'bigint'),
                             ('item_price_total', 'double'),
                             ('freight_total', 'double'),
                             ('gross_item_value', 'double'),
                             ('payment_record_count', 'bigint'),
                             ('payment_type_count', 'bigint'),
                             ('payment_value_total', 'double'),
                             ('maximum_installments', 'bigint'),
                             ('payment_types', 'string'),
                             ('uses_credit_card', 'boolean'),
                             ('uses_voucher', 'boolean'),
                             ('review_record_count', 'bigint'),
                             ('average_review_score', 'double'),
                             ('minimum_review_score', 'bigint'),
                             ('maximum_review_score', 'bigint'),
                             ('first_review_date', 'timestamp_ntz'),
                             ('latest_review_answer', 'timestamp_ntz'),
                             ('has_written_comment', 'boolean'),
                             ('payment_difference', 'double'),
                             ('has_item_record', 'boolean'),
                             ('has_payment_record', 'boolean'),
                             ('has_review_record', 'boolean'),
                             ('has_timestamp_anomaly', 'boolean'),
                             ('has_status_date_mismatch', 'boolean'),
                             ('is_valid_delivery_record', 'boolean')],
 'rejected_payments': [('reason', 'string'), ('rows', 'bigint'), ('without_value', 'bigint')],
 'retention_heatmap_frame': [('cohort_label', 'string'),
                             ('cohort_month', 'date'),
                             ('month_label', 'string'),
                             ('month_offset', 'bigint'),
                             ('retention_pct', 'double'),
                             ('heatmap_max', 'double')],
 'revenue_concentration': [('threshold_pct', 'double'),
                           ('products_required', 'bigint'),
                           ('total_product_count', 'bigint'),
                           ('product_share_required_pct', 'double')],
 'reviews_agg': [('order_id', 'string'),
                 ('review_record_count', 'bigint'),
                 ('average_review_score', 'double'),
                 ('minimum_review_score', 'bigint'),
                 ('maximum_review_score', 'bigint'),
                 ('first_review_date', 'timestamp_ntz'),
                 ('latest_review_answer', 'timestamp_ntz'),
                 ('has_written_comment', 'boolean')],
 'risk_segment_summary': [('seller_risk_segment', 'string'),
                          ('seller_count', 'bigint'),
                          ('high_value_seller_count', 'bigint'),
                          ('average_late_delivery_rate_pct', 'double'),
                          ('average_low_review_rate_pct', 'double'),
                          ('item_price_total', 'double')],
 'risk_summary_frame': [('seller_risk_segment', 'string'),
                        ('seller_count', 'bigint'),
                        ('high_value_seller_count', 'bigint'),
                        ('item_price_total', 'double'),
                        ('mean_late_delivery_rate_pct', 'double'),
                        ('mean_low_review_rate_pct', 'double'),
                        ('display_order', 'bigint')],
 'sales_kpis': [('completed_order_count', 'bigint'),
                ('completed_customer_count', 'bigint'),
                ('item_count', 'bigint'),
                ('item_price_total', 'double'),
                ('freight_total', 'double'),
                ('item_and_freight_total', 'double'),
                ('payment_value_total', 'double'),
                ('average_order_value', 'double'),
                ('average_items_per_order', 'double'),
                ('freight_share_pct', 'double'),
                ('payment_difference', 'double'),
                ('first_completed_purchase_date', 'date'),
                ('last_completed_purchase_date', 'date')],
 'sales_validation': [('metric_name', 'string'),
                      ('expected_value', 'double'),
                      ('actual_value', 'double'),
                      ('difference', 'double'),
                      ('passed', 'boolean')],
 'schema_overview': [('table_name', 'string'),
                     ('column_name', 'string'),
                     ('data_type', 'string'),
                     ('row_count', 'bigint'),
                     ('non_null_count', 'bigint'),
                     ('missing_count', 'bigint'),
                     ('missing_pct', 'double'),
                     ('unique_count', 'bigint')],
 'segment_distribution': [('customer_segment', 'string'),
                          ('customer_count', 'bigint'),
                          ('customer_share_pct', 'double')],
 'segment_summary': [('customer_segment', 'string'),
                     ('customer_count', 'bigint'),
                     ('customer_share_pct', 'double'),
                     ('completed_order_count', 'bigint'),
                     ('monetary_value', 'double'),
                     ('average_recency_days', 'double'),
                     ('average_completed_orders', 'double'),
                     ('average_customer_value', 'double')],
 'seller_order_performance': [('order_id', 'string'),
                              ('seller_id', 'string'),
                              ('seller_city', 'string'),
                              ('seller_state', 'string'),
                              ('customer_unique_id', 'string'),
                              ('customer_city', 'string'),
                              ('customer_state', 'string'),
                              ('purchase_date', 'date'),
                              ('purchase_month', 'date'),
                              ('item_count', 'bigint'),
                              ('distinct_product_count', 'bigint'),
                              ('category_count', 'bigint'),
                              ('item_price_total', 'double'),
                              ('freight_total', 'double'),
                              ('gross_item_value', 'double'),
                              ('shipped_after_shipping_limit', 'boolean'),
                              ('carrier_handling_days', 'bigint'),
                              ('delivery_days', 'bigint'),
                              ('estimated_delivery_days', 'bigint'),
                              ('delivery_delay_days', 'bigint'),
                              ('is_late_delivery', 'boolean'),
                              ('is_valid_delivery_record', 'boolean'),
                              ('average_review_score', 'double'),
                              ('has_review_record', 'boolean'),
                              ('has_written_comment', 'boolean'),
                              ('is_multi_seller_order', 'boolean'),
                              ('is_same_state_delivery', 'boolean')],
 'seller_performance': [('seller_id', 'string'),
                        ('seller_city', 'string'),
                        ('seller_state', 'string'),
                        ('completed_order_count', 'bigint'),
                        ('customer_count', 'bigint'),
                        ('item_count', 'bigint'),
                        ('item_price_total', 'double'),
                        ('freight_total', 'double'),
                        ('gross_item_value', 'double'),
                        ('average_item_value_per_order', 'double'),
                        ('average_items_per_order', 'double'),
                        ('valid_delivery_order_count', 'bigint'),
                        ('late_delivery_order_count', 'bigint'),
                        ('late_delivery_rate_pct', 'double'),
                        ('average_delivery_days', 'double'),
                        ('average_carrier_handling_days', 'double'),
                        ('average_delay_days_when_late', 'double'),
                        ('shipping_limit_breach_count', 'bigint'),
                        ('shipping_limit_breach_rate_pct', 'double'),
                        ('reviewed_order_count', 'bigint'),
                        ('average_review_score', 'double'),
                        ('low_review_order_count', 'bigint'),
                        ('low_review_rate_pct', 'double'),
                        ('same_state_order_count', 'bigint'),
                        ('same_state_delivery_rate_pct', 'double'),
                        ('first_completed_purchase_date', 'date'),
                        ('last_completed_purchase_date', 'date'),
                        ('distinct_product_count', 'bigint'),
                        ('distinct_category_count', 'bigint'),
                        ('seller_revenue_rank', 'bigint'),
                        ('seller_revenue_share_pct', 'double')],
 'seller_risk': [('seller_id', 'string'),
                 ('seller_city', 'string'),
                 ('seller_state', 'string'),
                 ('completed_order_count', 'bigint'),
                 ('customer_count', 'bigint'),
                 ('item_count', 'bigint'),
                 ('item_price_total', 'double'),
                 ('valid_delivery_order_count', 'bigint'),
                 ('late_delivery_rate_pct', 'double'),
                 ('average_delivery_days', 'double'),
                 ('shipping_limit_breach_rate_pct', 'double'),
                 ('reviewed_order_count', 'bigint'),
                 ('average_review_score', 'double'),
                 ('low_review_rate_pct', 'double'),
                 ('seller_revenue_rank', 'bigint'),
                 ('seller_revenue_share_pct', 'double'),
                 ('late_delivery_quartile', 'bigint'),
                 ('shipping_breach_quartile', 'bigint'),
                 ('low_review_quartile', 'bigint'),
                 ('operational_risk_score', 'bigint'),
                 ('is_high_value_seller', 'boolean'),
                 ('seller_risk_segment', 'string')],
 'share_checks': [('view_name', 'string'), ('total_share_pct', 'double')],
 'state_delivery': [('customer_state', 'string'),
                    ('completed_order_count', 'bigint'),
                    ('customer_count', 'bigint'),
                    ('payment_value_total', 'double'),
                    ('freight_total', 'double'),
                    ('freight_share_pct', 'double'),
                    ('valid_delivery_order_count', 'bigint'),
                    ('late_delivery_order_count', 'bigint'),
                    ('late_delivery_rate_pct', 'double'),
                    ('average_delivery_days', 'double'),
                    ('average_estimated_delivery_days', 'double'),
                    ('average_delivery_delay_days', 'double'),
                    ('average_delay_days_when_late', 'double'),
                    ('reviewed_order_count', 'bigint'),
                    ('average_review_score', 'double'),
                    ('low_review_order_count', 'bigint'),
                    ('low_review_rate_pct', 'double')],
 'state_scatter_frame': [('customer_state', 'string'),
                         ('completed_order_count', 'bigint'),
                         ('average_delivery_days', 'double'),
                         ('late_delivery_rate_pct', 'double'),
                         ('average_review_score', 'double'),
                         ('overall_delivery_days', 'double'),
                         ('overall_late_rate', 'double'),
                         ('bubble_size', 'double')],
 'states_by_late_rate': [('customer_state', 'string'),
                         ('completed_order_count', 'bigint'),
                         ('customer_count', 'bigint'),
                         ('freight_share_pct', 'double'),
                         ('late_delivery_rate_pct', 'double'),
                         ('average_delivery_days', 'double'),
                         ('average_delay_days_when_late', 'double'),
                         ('average_review_score', 'double'),
                         ('low_review_rate_pct', 'double')],
 'status_counts': [('order_status', 'string'), ('order_count', 'bigint'), ('order_pct', 'double')],
 'table_row_counts': [('table_name', 'string'), ('row_count', 'bigint')],
 'top_activity_months': [('activity_month', 'date'),
                         ('active_customer_count', 'bigint'),
                         ('new_customer_count', 'bigint'),
                         ('returning_customer_count', 'bigint'),
                         ('order_count', 'bigint'),
                         ('payment_value', 'double'),
                         ('active_customer_growth_pct', 'double')],
 'top_categories_frame': [('product_category_name_english', 'string'),
                          ('category_label', 'string'),
                          ('item_price_total', 'double'),
                          ('freight_share_pct', 'double'),
                          ('overall_freight_share_pct', 'double')],
 'top_products': [('product_id', 'string'),
                  ('product_category_name_english', 'string'),
                  ('order_count', 'bigint'),
                  ('item_count', 'bigint'),
                  ('customer_count', 'bigint'),
                  ('seller_count', 'bigint'),
                  ('item_price_total', 'double'),
                  ('freight_total', 'double'),
                  ('average_item_price', 'double'),
                  ('minimum_item_price', 'double'),
                  ('maximum_item_price', 'double'),
                  ('first_purchase_date', 'date'),
                  ('last_purchase_date', 'date'),
                  ('item_revenue_rank', 'bigint'),
                  ('item_revenue_share_pct', 'double'),
                  ('cumulative_item_revenue_pct', 'double')],
 'top_sellers': [('seller_id', 'string'),
                 ('seller_state', 'string'),
                 ('completed_order_count', 'bigint'),
                 ('customer_count', 'bigint'),
                 ('item_price_total', 'double'),
                 ('late_delivery_rate_pct', 'double'),
                 ('shipping_limit_breach_rate_pct', 'double'),
                 ('average_review_score', 'double'),
                 ('low_review_rate_pct', 'double'),
                 ('seller_revenue_rank', 'bigint')],
 'untranslated_categories': [('product_category_name', 'string'), ('product_rows', 'bigint')],
 'zip_coverage': [('table_name', 'string'),
                  ('zip_column', 'string'),
                  ('total_rows', 'bigint'),
                  ('unmatched_rows', 'bigint'),
                  ('unmatched_unique_zip_codes', 'bigint'),
                  ('coverage_pct', 'double')]}
