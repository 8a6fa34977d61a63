"""Hot keys and plan shapes that matter at scale, checked on small inputs."""
from decimal import Decimal

from pyspark.sql import functions as F

from payment_helpers import SF_SMALL, make_data
from ledgerlens.operators.quality import referential_counts
from ledgerlens.plans import extras, ingest, views
from ledgerlens.plans.data import PaymentData
from ledgerlens.schema import STAGING


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_customer_rollup(spark):
    # one customer holds a third of the rows
    rows = [(i, i, 10) for i in range(90)]
    data = make_data(spark, rows, [(i, False) for i in range(90)])
    tx = data.transactions.withColumn("customer_id", F.when(F.col("transaction_id") % 3 == 0, 7)
                                      .otherwise(F.col("transaction_id") + 100))
    out = {r.customer_id: r for r in extras.customer_rollup(PaymentData(tx, data.fraud_cases)).collect()}
    assert out[7].total_transactions == 30 and out[7].total_amount == Decimal("300.00")
    assert len(out) == 61
    # map-side partial aggregation before the shuffle
    assert "partial_count" in _plan(extras.customer_rollup(PaymentData(tx, data.fraud_cases)))


def test_referential_counts_aggregate_before_join(spark):
    children = spark.createDataFrame([(1,)] * 50 + [(2,), (99,), (None,)], "transaction_id long")
    parents = spark.createDataFrame([(1,), (2,), (3,)], "transaction_id long")
    df = referential_counts(children, parents, "transaction_id", "case", "transaction")
    got = {r.check_name: r.row_count for r in df.collect()}
    assert got == {"case without transaction": 1, "transaction without case": 1}
    plan = _plan(df)
    join_at = plan.index("Join")
    assert "partial_count" in plan[join_at:]  # both inputs reduced per key below the join


def test_label_join_with_hot_duplicate_group(spark):
    # a third of the staging rows are one repeated row: no k x k fan-out
    base = [Decimal("0.1")] + [Decimal(0)] * 27
    hot = [(5, *base, Decimal("9.99"), 1)] * 30
    other = [(t, Decimal(t) / 100, *[Decimal(0)] * 27, Decimal(t), 0) for t in range(6, 66)]
    staging = spark.createDataFrame(hot + other, STAGING)
    loaded = ingest.load_all(staging)
    cases = loaded.fraud_cases
    assert loaded.transactions.count() == 90
    assert cases.count() == 90  # one case per transaction, duplicates folded
    assert cases.where("is_fraud").count() == 30
    assert "HashAggregate" in _plan(cases)  # distinct label side before the join


def test_snapshot_views_overwrite_only_their_date(spark, scratch):
    data = PaymentData.from_testdata(spark, SF_SMALL)
    views.snapshot_views(data, scratch, "2024-02-01 08:00:00")
    views.snapshot_views(data, scratch, "2024-02-02 08:00:00")
    views.snapshot_views(data, scratch, "2024-02-02 09:00:00")  # rerun of the same date
    snap = spark.read.parquet(f"{scratch}/executive_dashboard")
    by_date = {str(r.snapshot_date): r["count"] for r in snap.groupBy("snapshot_date").count().collect()}
    assert by_date == {"2024-02-01": 1, "2024-02-02": 1}
    risky = spark.read.parquet(f"{scratch}/high_risk_transactions")
    assert risky.where("snapshot_date = '2024-02-02'").count() == 5


def test_label_keys_are_digested_once_a_row(spark):
    # the ordered table holds the digest: neither side of the label join rounds or digests the 30 keys again
    rows = [(t, *[Decimal(t) / 1000] * 28, Decimal(t), t % 2) for t in (3, 1, 2, 2)]
    loaded = ingest.load_all(spark.createDataFrame([*rows, (2, *rows[2][1:-1], 1)], STAGING), as_of="2024-01-01")
    assert sorted((r.transaction_id, r.is_fraud) for r in loaded.fraud_cases.collect()) == [
        (1, True), (2, False), (2, True), (3, False), (3, True), (4, False), (4, True), (5, True)]
    ordered = ingest._ordered_rows(loaded.staging, digest=True)
    own = ingest.number_ordered(ordered.select("_pid", "_pos", "_digest"), "transaction_id")
    assert "sha2(" not in _plan(ingest._cases_by_digest(own, ordered.select("class", "_digest")))


def test_events_are_dealt_out_before_the_features(spark, scratch):
    # one row group under several splits: only one of them holds rows
    spark.range(2000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "1L AS user_id", "'view' AS event_type",
        "1.5D AS value", "repeat(sha2(CAST(id AS STRING), 256), 9) AS props").coalesce(1).write.parquet(scratch + "/e")
    events = spark.read.parquet(scratch + "/e")
    sizes = [n for n in ingest.staging_of(events).rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()]
    assert sum(sizes) == 2006 and max(sizes) < 1000
