"""SQL access: temporary views and the table function with defaults."""
from payment_helpers import SF_SMALL
from ledgerlens.plans import params, views
from ledgerlens.plans.data import PaymentData


def test_views_answer_the_documented_queries(spark):
    data = PaymentData.from_testdata(spark, SF_SMALL)
    names = views.register_views(data)
    assert "high_risk_transactions" in names
    block = spark.sql("SELECT * FROM high_risk_transactions WHERE recommended_action = 'IMMEDIATE_BLOCK'").collect()
    assert len(block) == 1 and block[0].transaction_id == 0
    hourly = spark.sql("SELECT * FROM fraud_hourly_stats ORDER BY fraud_rate_percentage DESC").collect()
    assert len(hourly) == 24
    assert spark.sql("SELECT * FROM executive_dashboard").count() == 1
    assert spark.sql("SELECT * FROM detection_performance_summary").count() == 3


def test_table_function_matches_dataframe_function(spark):
    data = PaymentData.from_testdata(spark, SF_SMALL)
    name = params.register_sql_function(data)
    as_sql = [tuple(r) for r in spark.sql(f"SELECT * FROM {name}(2, 6, 12.0)").collect()]
    as_df = [tuple(r) for r in params.analyze_fraud_by_parameters(data, 2, 6, 12.0).collect()]
    assert as_sql == as_df and len(as_sql) == 5
    defaults = [tuple(r) for r in spark.sql(f"SELECT * FROM {name}()").collect()]
    assert defaults == [tuple(r) for r in params.analyze_fraud_by_parameters(data).collect()]
    named = spark.sql(f"SELECT * FROM {name}(end_hour => 3)").collect()
    assert [r.hour_of_day for r in named] == [0, 1, 2, 3]
