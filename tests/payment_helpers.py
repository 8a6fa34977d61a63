"""Test folder and hand-written tables that the payment tests share."""

from decimal import Decimal

SF_SMALL = "/root/testdata/sf0.001"


def make_data(spark, tx_rows, fc_rows):
    """PaymentData from hand-written rows.

    tx_rows: (transaction_id, transaction_time, amount, v1..v5) with amount and
    v's as numbers or strings; fc_rows: (transaction_id, is_fraud)."""
    from pyspark.sql import types as T

    from ledgerlens.plans.data import PaymentData

    tx_schema = T.StructType([
        T.StructField("transaction_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("transaction_time", T.IntegerType()),
        T.StructField("amount", T.DecimalType(10, 2)),
        *[T.StructField(f"v{i}", T.DecimalType(10, 6)) for i in range(1, 6)],
    ])
    fc_schema = T.StructType([T.StructField("transaction_id", T.LongType()), T.StructField("is_fraud", T.BooleanType())])
    rows = []
    for r in tx_rows:
        tid, t, amount, *vs = r
        vs = list(vs) + [0] * (5 - len(vs))
        rows.append((tid, 1, t, Decimal(str(amount)), *[None if v is None else Decimal(str(v)) for v in vs]))
    tx = spark.createDataFrame(rows, tx_schema)
    fc = spark.createDataFrame(list(fc_rows), fc_schema)
    return PaymentData(tx, fc)
