"""Declared schemas of the payment data model (never inferred)."""

from pyspark.sql import types as T

from .constants import N_FEATURES

FEATURES = [f"v{i}" for i in range(1, N_FEATURES + 1)]

STAGING = T.StructType(
    [T.StructField("time_seconds", T.IntegerType())]
    + [T.StructField(v, T.DecimalType(15, 10)) for v in FEATURES]
    + [T.StructField("amount", T.DecimalType(10, 2)), T.StructField("class", T.IntegerType())]
)

# the file layout as delivered: header Time, V1..V28, Amount, Class
CSV_FILE = T.StructType(
    [T.StructField("Time", T.IntegerType())]
    + [T.StructField(v.upper(), T.DecimalType(15, 10)) for v in FEATURES]
    + [T.StructField("Amount", T.DecimalType(10, 2)), T.StructField("Class", T.IntegerType())]
)

TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.LongType(), False),
        T.StructField("customer_id", T.LongType()),
        T.StructField("amount", T.DecimalType(10, 2), False),
        T.StructField("transaction_time", T.IntegerType(), False),
        T.StructField("transaction_timestamp", T.TimestampType()),
    ]
    + [T.StructField(v, T.DecimalType(10, 6)) for v in FEATURES]
    + [T.StructField("created_at", T.TimestampType())]
)

FRAUD_CASES = T.StructType(
    [
        T.StructField("case_id", T.LongType(), False),
        T.StructField("transaction_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("is_fraud", T.BooleanType(), False),
        T.StructField("detection_method", T.StringType()),
        T.StructField("fraud_probability", T.DecimalType(5, 4)),
        T.StructField("investigation_status", T.StringType()),
        T.StructField("reported_date", T.TimestampType()),
        T.StructField("resolved_date", T.TimestampType()),
        T.StructField("financial_loss", T.DecimalType(10, 2)),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
