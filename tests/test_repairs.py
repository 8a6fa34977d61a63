"""Cases the fixture does not hold: labels, hot keys, short data, sessions."""
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from payment_helpers import SF_SMALL, make_data
from ledgerlens import session
from ledgerlens.operators import ids
from ledgerlens.plans import ingest, report
from ledgerlens.plans.data import PaymentData
from ledgerlens.plans.registry import QUERIES
from ledgerlens.schema import STAGING

ZEROS = [Decimal(0)] * 28


def _cases(spark, classes):
    staging = spark.createDataFrame([(5, *ZEROS, Decimal("9.99"), c) for c in classes], STAGING)
    loaded = ingest.load_all(staging, "2024-01-01")
    return sorted((r.transaction_id, r.is_fraud) for r in loaded.fraud_cases.collect())


def test_a_row_without_class_is_a_case_that_is_not_fraud(spark):
    assert _cases(spark, [None]) == [(1, False)]


def test_codes_other_than_one_are_the_same_label(spark):
    assert _cases(spark, [0, 2]) == [(1, False), (2, False)]
    assert _cases(spark, [0, 1, None]) == [(i, f) for i in (1, 2, 3) for f in (False, True)]


def test_loaded_tables_are_complete(spark):
    loaded = ingest.loaded_from_testdata(spark, SF_SMALL)
    assert {"transaction_timestamp", "created_at"} <= set(loaded.transactions.columns)
    assert {"case_id", "investigation_status", "reported_date", "resolved_date", "financial_loss"} <= set(loaded.fraud_cases.columns)
    n = loaded.fraud_cases.count()
    assert loaded.fraud_cases.agg(F.min("case_id"), F.max("case_id"), F.count_distinct("case_id")).first() == (1, n, n)


def test_hot_label_key_is_split(spark):
    """One key on 60,000 transactions: AQE splits its partition of the join."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        features = [F.lit(0).cast("decimal(10,6)").alias(f"v{i}") for i in range(1, 29)]
        tx = spark.range(80_000).select(
            F.col("id").alias("transaction_id"),
            F.when(F.col("id") < 60_000, 1).otherwise(F.col("id") % 5000).cast("decimal(10,2)").alias("amount"),
            F.lit(0).alias("transaction_time"), *features)
        staging = tx.withColumnRenamed("transaction_time", "time_seconds").withColumn("class", (F.col("transaction_id") % 2).cast("int"))
        cases = ingest.load_fraud_cases(tx, staging.drop("transaction_id"))
        assert cases.count() > 60_000
        rows = cases.select("is_fraud", F.xxhash64("transaction_id").alias("h")).where("h % 7 = 0")
        rows.collect()
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_reports_of_a_single_hour_keep_their_rows(spark):
    data = make_data(spark, [(1, 10, 5, 1, 2, 3), (2, 20, 500, 2, 1, 9)], [(1, True), (2, False)])
    rows = {r.recommendation_type: r for r in report.operational_insights(data).collect()}
    assert len(rows) == 6
    assert rows["Peak Risk Hours"].timeframe == "n/a"
    assert rows["Transaction Segments"].timeframe.startswith("Micro")
    empty = PaymentData(data.transactions.limit(0), data.fraud_cases.limit(0))
    assert report.operational_insights(empty).count() == 6


def test_hours_of_three_digits_are_not_cut(spark):
    start = 86400 + 100 * 3600
    data = make_data(spark, [(1, start, 5), (2, start + 3600, 6)], [(1, True), (2, True)])
    rows = {r.recommendation_type: r.timeframe for r in report.operational_insights(data).collect()}
    assert rows["Peak Risk Hours"] == "100:00-102:00"


def test_every_hour_of_the_stream_is_reported(spark):
    hours = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(F.date_trunc("hour", "ts")).distinct().count()
    out = QUERIES["stream_hourly_alerts"](spark, SF_SMALL)
    assert out.count() == hours and out.select("window_start").distinct().count() == hours


def test_no_scratch_folder_of_one_machine_on_a_cluster():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    cluster = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(cluster)


def test_ranges_follow_the_input(spark):
    small = spark.range(10)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ids.ranges_for(small) == least
    assert ids.ranges_for(spark.range(10_000_000), bytes_per_range=1 << 20) >= 70
    wide = spark.range(1_000_000).withColumnRenamed("id", "a")
    joined = wide.join(wide.withColumnRenamed("a", "b"), F.col("a") == F.col("b"))
    assert ids.ranges_for(joined, bytes_per_range=1 << 20) <= 16  # not the product of the sides
