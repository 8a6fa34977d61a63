"""Output columns the registered queries expose as DOUBLE.

The library keeps money and ratios as DECIMAL; the registered queries (the
driver-facing outputs) cast every DECIMAL column to DOUBLE so that results
compare the same however they are fetched (Python Decimal, pandas float,
Arrow). The conversion of one rounded decimal is exact on both engines, so the
doubles are identical. This list names those columns per query so the
oracle applies the same cast; ``tests/test_oracle.py`` checks that the
column types of both sides agree.
"""

DOUBLE_COLUMNS: dict[str, tuple[str, ...]] = {
    "ingest_staging": ('v1', 'v2', 'v3', 'v4', 'v5', 'v6', 'v7', 'v8', 'v9', 'v10', 'v11', 'v12', 'v13', 'v14', 'v15', 'v16', 'v17', 'v18', 'v19', 'v20', 'v21', 'v22', 'v23', 'v24', 'v25', 'v26', 'v27', 'v28', 'amount', 'class',),
    "load_transactions": ('amount', 'v1', 'v2', 'v3', 'v4', 'v5', 'v6', 'v7', 'v8', 'v9', 'v10', 'v11', 'v12', 'v13', 'v14', 'v15', 'v16', 'v17', 'v18', 'v19', 'v20', 'v21', 'v22', 'v23', 'v24', 'v25', 'v26', 'v27', 'v28',),
    "load_fraud_cases": ("fraud_probability", "financial_loss"),
    "fraud_distribution": ('percentage',),
    "amount_threshold_sweep": ('precision_percentage',),
    "amount_flagged_top50": ('amount', 'avg_amount', 'optimal_threshold', 'amount_percentile',),
    "hourly_fraud": ('fraud_rate_percentage', 'fraud_distribution_percentage',),
    "zscore_threshold_sweep": ('precision_percentage',),
    "zscore_outliers_top50": ('amount', 'v1_zscore', 'v2_zscore', 'v3_zscore', 'v4_zscore', 'v5_zscore', 'avg_zscore',),
    "v3_pattern_top100": ('amount', 'v3_zscore',),
    "method_comparison": ('precision_percentage', 'recall_percentage',),
    "view_fraud_hourly_stats": ('fraud_rate_percentage', 'fraud_distribution_percentage',),
    "view_high_risk_transactions": ('amount', 'v3_risk_score',),
    "view_detection_performance": ('precision_percentage',),
    "analyze_fraud_by_parameters": ('fraud_rate',),
    "analyze_fraud_by_parameters_2_6_12": ('fraud_rate',),
    "hourly_financials": ('fraud_rate_percentage', 'fraud_loss_ratio_percentage',),
    "segment_analysis": ('fraud_rate_percentage', 'volume_loss_percentage', 'transaction_share_percentage', 'volume_share_percentage',),
    "period_trends": ('fraud_rate_percentage', 'low_value_percentage', 'medium_value_percentage', 'high_value_percentage', 'high_value_fraud_rate',),
    "view_executive_dashboard": ('fraud_rate', 'total_volume', 'fraud_loss', 'loss_percentage', 'avg_transaction',),
    "view_segment_performance": ('fraud_rate', 'volume', 'fraud_volume', 'loss_rate',),
    "detector_extras": ('precision_percentage', 'recall_percentage', 'false_discovery_percentage', 'workload_reduction_percentage',),
    "customer_rollup": ('total_amount', 'avg_transaction_amount',),
    "amount_percentiles": ('p95_amount', 'p99_amount',),
    "v3_profile": ('v3_mean', 'v3_stddev', 'v3_min', 'v3_max',),
    "stream_score": ('amount', 'v3_risk_score',),
    "stream_hourly_alerts": ('volume',),
    "stream_rule_episodes": ('volume', 'max_risk_score'),
}

DOUBLE_COLUMNS["amount_flagged_ranked"] = DOUBLE_COLUMNS["amount_flagged_top50"]
DOUBLE_COLUMNS["hourly_amount_percentiles"] = ("p50_amount", "p95_amount", "p99_amount")
DOUBLE_COLUMNS["append_load"] = ("amount", "v1", "v27")
DOUBLE_COLUMNS |= {f"stored_view_{stored}": DOUBLE_COLUMNS[own] for stored, own in {
    "fraud_hourly_stats": "view_fraud_hourly_stats", "high_risk_transactions": "view_high_risk_transactions",
    "detection_performance_summary": "view_detection_performance", "executive_dashboard": "view_executive_dashboard",
    "segment_performance": "view_segment_performance"}.items()}
DOUBLE_COLUMNS["csv_ingest_round_trip"] = DOUBLE_COLUMNS["ingest_staging"]
DOUBLE_COLUMNS["sql_table_function"] = DOUBLE_COLUMNS["analyze_fraud_by_parameters"]

# always-NULL columns left out of the registered outputs
DROPPED_COLUMNS: dict[str, tuple[str, ...]] = {
    "load_transactions": ("customer_id", "transaction_timestamp"),
    "load_fraud_cases": ("customer_id", "resolved_date"),
}
