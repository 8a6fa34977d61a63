"""Streaming jobs: scoring equals the batch rule with the same snapshot;
late rows beyond the watermark are dropped."""
import datetime as dt

from payment_helpers import SF_SMALL
from ledgerlens.operators.stats import column_stats
from ledgerlens.plans import views
from ledgerlens.plans.data import PaymentData
from ledgerlens.schema import EVENTS
from ledgerlens.sources import fixtures
from ledgerlens.streaming import score


def test_stream_scoring_equals_batch_rule(spark):
    streamed = score.stream_score_testdata(spark, SF_SMALL)
    batch = views.high_risk_transactions(PaymentData.from_testdata(spark, SF_SMALL), include_timestamp=False)
    a = {(r.transaction_id, r.v3_risk_score, r.recommended_action) for r in streamed.collect()}
    b = {(r.transaction_id, r.v3_risk_score, r.recommended_action) for r in batch.collect()}
    assert a == b and len(a) == 5


def _events(spark, rows):
    return spark.createDataFrame(
        [(i, ts, 1, "click", 10.0, "{}") for i, ts in rows], EVENTS)


def test_late_row_beyond_watermark_is_dropped(spark, scratch):
    # Spark drops a late row for certain only once its window has been
    # emitted and evicted; before that it may still be counted (documented).
    d = dt.datetime
    batches = [
        [(1, d(2024, 1, 1, 10, 5)), (2, d(2024, 1, 1, 10, 40)), (3, d(2024, 1, 1, 12, 30))],  # watermark 11:30
        [(5, d(2024, 1, 1, 12, 40)), (6, d(2024, 1, 1, 14, 0))],  # emits 10:00-11:00; watermark 13:00
        [(4, d(2024, 1, 1, 10, 15)),    # late: its window is gone, dropped
         (7, d(2024, 1, 1, 16, 0))],    # watermark 15:00 emits 12:00 and 14:00
    ]
    for i, rows in enumerate(batches):
        _events(spark, rows).coalesce(1).write.parquet(f"{scratch}/in/part={i}")
    static = fixtures.transactions(spark.read.schema(EVENTS).parquet(f"{scratch}/in/*"))
    stats = column_stats(static, ["v3"])
    stream = score.hourly_alert_stream(
        score.transaction_stream(score.event_stream(spark, f"{scratch}/in/*", max_files_per_trigger=1)), stats)
    q = score.run_to_parquet(stream, f"{scratch}/out", f"{scratch}/ck")
    q.awaitTermination()
    got = {r.window_start: r.transactions for r in spark.read.parquet(f"{scratch}/out").collect()}
    assert got == {"2024-01-01 10:00:00": 2, "2024-01-01 12:00:00": 2, "2024-01-01 14:00:00": 1}
    dropped = sum(s.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for s in p["stateOperators"])
    assert dropped == 1


def test_restart_resumes_from_checkpoint_without_duplicates(spark, scratch):
    d = dt.datetime
    snapshot_rows = [(i, d(2024, 1, 1)) for i in range(10, 20)]
    stats = column_stats(fixtures.transactions(_events(spark, snapshot_rows)), ["v3"])

    def run():
        stream = score.score_stream(score.transaction_stream(score.event_stream(spark, f"{scratch}/in/*")), stats,
                                    watch_z=-1.0)  # every row passes: counts are easy to check
        q = score.run_to_parquet(stream, f"{scratch}/out", f"{scratch}/ck")
        q.awaitTermination()
        return spark.read.parquet(f"{scratch}/out")

    _events(spark, [(1, d(2024, 1, 1, 1)), (2, d(2024, 1, 1, 2))]).write.parquet(f"{scratch}/in/part=0")
    assert run().count() == 2
    # a new file arrives; the restarted query reads only the new offsets
    _events(spark, [(3, d(2024, 1, 1, 3))]).write.parquet(f"{scratch}/in/part=1")
    out = run()
    assert sorted(r.transaction_id for r in out.collect()) == [1, 2, 3]
