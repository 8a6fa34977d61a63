"""The parameterised hourly analysis: a DataFrame function and an SQL table
function with the same defaults.

The V3 z-score is taken over *all* labelled rows (one broadcast statistics
row); the hour range is applied afterwards, so a narrow range does not change
the scores. A start after the end yields no rows; the range does not wrap
around midnight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import hour_of_day
from ..functions.numeric import half_up_ratio
from .data import PaymentData
from .detect import v3_scored

FUNCTION_NAME = "analyze_fraud_by_parameters"


def analyze_fraud_by_parameters(data: PaymentData, start_hour: int = 0, end_hour: int = 23,
                                v3_threshold: float = 10.0) -> DataFrame:
    scored = v3_scored(data, extra=("transaction_time",)).select(
        hour_of_day(F.col("transaction_time")).alias("hour_of_day"), "is_fraud", "v3_z"
    )
    g = (
        scored.where(F.col("hour_of_day").between(start_hour, end_hour))
        .groupBy("hour_of_day")
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            F.count_if(F.col("is_fraud")).alias("fraud_count"),
            F.count_if(F.col("v3_z") > F.lit(float(v3_threshold))).alias("high_risk_transactions"),
        )
    )
    return g.select(
        "hour_of_day",
        "total_transactions",
        "fraud_count",
        half_up_ratio(F.col("fraud_count"), F.col("total_transactions"), 3, factor=100).alias("fraud_rate"),
        "high_risk_transactions",
    ).orderBy("hour_of_day")


def register_sql_function(data: PaymentData, view: str = "labelled_transactions") -> str:
    """Register ``analyze_fraud_by_parameters(start_hour, end_hour,
    v3_threshold)`` as a temporary SQL table function over ``view``.

    Positional, named (``end_hour => 3``) and default arguments all work. The
    statistics come from a one-row aggregate cross-joined to the rows (not a
    global window), and a parameter may not sit inside an aggregate FILTER, so
    the flag is a CASE in the inner select.
    """
    spark: SparkSession = data.spark
    data.labelled.createOrReplaceTempView(view)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {FUNCTION_NAME}(
            start_hour INT DEFAULT 0, end_hour INT DEFAULT 23, v3_threshold DOUBLE DEFAULT 10.0)
        RETURNS TABLE (hour_of_day INT, total_transactions BIGINT, fraud_count BIGINT,
                       fraud_rate DECIMAL(18,3), high_risk_transactions BIGINT)
        RETURN
        WITH s AS (SELECT avg(CAST(v3 AS DOUBLE)) AS m, stddev_samp(CAST(v3 AS DOUBLE)) AS sd FROM {view}),
        t AS (
            SELECT CAST(CASE WHEN l.transaction_time < 86400 THEN l.transaction_time
                             ELSE l.transaction_time - 86400 END div 3600 AS INT) AS hour_of_day,
                   l.is_fraud,
                   CASE WHEN abs(CAST(l.v3 AS DOUBLE) - s.m) / nullif(s.sd, 0) > v3_threshold THEN 1 END AS hr
            FROM {view} l CROSS JOIN s)
        SELECT hour_of_day, count(*) AS total_transactions, count_if(is_fraud) AS fraud_count,
               CAST(CASE WHEN count(*) = 0 THEN NULL
                    ELSE (2 * 100000 * count_if(is_fraud) + count(*)) div (2 * count(*)) END
                    * 0.001 AS DECIMAL(18,3)) AS fraud_rate,
               count(hr) AS high_risk_transactions
        FROM t WHERE hour_of_day BETWEEN start_hour AND end_hour
        GROUP BY hour_of_day ORDER BY hour_of_day
    """)
    return FUNCTION_NAME
