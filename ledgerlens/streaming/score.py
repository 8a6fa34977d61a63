"""Structured Streaming: the V3 rules applied to arriving transactions.

* ``score_stream`` (real-time detection): each arriving transaction is scored
  against a *statistics snapshot* — one row (mean, sd of V3) written by a
  batch job and read back as a tiny static table. The stream-static cross
  join broadcasts that row; the snapshot is refreshed by rerunning the batch
  job, not per micro-batch. This differs from the batch views, where every
  row is part of its own statistics.
* ``hourly_alert_stream``: event-time windows of one hour with a watermark;
  append mode emits a window once the watermark passes its end, and rows
  older than the watermark are dropped (late data). A source that ends closes
  its last windows by a heartbeat (``alerts.py``, which also has the alerts
  with a cooldown).

Sinks are Parquet folders with their own checkpoint folder, both under the
cluster's shared checkpoint directory, so a restarted query resumes exactly
once from its offsets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from ..functions.numeric import half_up_round
from ..operators.stats import column_stats, zscore
from ..plans.data import PaymentData
from ..plans.detect import pattern_action, pattern_flag
from ..schema import EVENTS
from ..session import checkpoint_path
from ..sources import fixtures
from . import alerts


def write_stats_snapshot(data: PaymentData, path: str, features=("v3",)) -> DataFrame:
    """Compute the one-row statistics over labelled rows and write them."""
    column_stats(data.labelled, list(features)).coalesce(1).write.mode("overwrite").parquet(path)
    return data.spark.read.parquet(path)


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Arriving events from a folder (or glob) of Parquet files, declared schema."""
    reader = spark.readStream.schema(EVENTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def transaction_stream(events: DataFrame) -> DataFrame:
    """Events mapped to transactions, keeping the event time. The event
    table's wall-clock time (no zone) is read as UTC, so windows and their
    labels do not depend on the session time zone."""
    return fixtures.transactions(events, keep=(F.timestamp_seconds(F.unix_timestamp("ts")).alias("event_time"),))


def utc_text(ts) -> "F.Column":
    """'yyyy-MM-dd HH:mm:ss' of an instant as UTC wall-clock time, whatever
    the session time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def score_stream(transactions: DataFrame, stats: DataFrame, watch_z: float = C.MONITOR_V3_Z) -> DataFrame:
    scored = transactions.crossJoin(F.broadcast(stats)).withColumn("v3_z", zscore("v3"))
    return scored.where(F.col("v3_z") > F.lit(watch_z)).select(
        "transaction_id",
        utc_text(F.col("event_time")).alias("event_time"),
        "amount",
        half_up_round(F.col("v3_z"), 2).alias("v3_risk_score"),
        pattern_action(F.col("v3_z"), F.col("amount")).alias("recommended_action"),
    )


def _alert_windows(scored: DataFrame, window: str) -> DataFrame:
    return (
        scored.groupBy(F.window("event_time", window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            F.count_if(F.col("v3_z") > F.lit(C.MONITOR_V3_Z)).alias("high_risk"),
            F.count_if(pattern_flag(F.col("v3_z"), F.col("amount"))).alias("immediate_block"),
            F.sum("amount").alias("volume"),
        )
        .select(
            utc_text(F.col("w.start")).alias("window_start"),
            utc_text(F.col("w.end")).alias("window_end"),
            "transactions", "high_risk", "immediate_block", "volume",
        )
    )


def hourly_alert_stream(transactions: DataFrame, stats: DataFrame, delay: str = "1 hour",
                        window: str = "1 hour") -> DataFrame:
    scored = transactions.crossJoin(F.broadcast(stats)).withColumn("v3_z", zscore("v3"))
    return _alert_windows(scored.withWatermark("event_time", delay), window)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                   processing_time: str | None = None) -> StreamingQuery:
    writer = (stream.writeStream.format("parquet").option("path", path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()


def _run(spark: SparkSession, name: str, build) -> DataFrame:
    base = checkpoint_path(spark, f"streams/{name}-{uuid.uuid4().hex}")
    stream = build(base)
    query = run_to_parquet(stream, f"{base}/out", f"{base}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_score_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 over a test-data folder: the events file as a stream source."""
    data = PaymentData.from_testdata(spark, sf_dir)

    def build(base: str) -> DataFrame:
        stats = write_stats_snapshot(data, f"{base}/stats")
        return score_stream(transaction_stream(event_stream(spark, _events_glob(sf_dir))), stats)

    return _run(spark, "score", build)


def run_to_end(spark: SparkSession, name: str, sf_dir: str, build, conf: dict | None = None) -> DataFrame:
    """A stream over the events of a folder, run until its source ends.

    ``build(transactions, stats)`` makes the stream; ``conf`` holds for it alone. The
    first run takes all files there are; then the end is written, and the query,
    restarted from its checkpoint, emits what was still open in its state.
    """
    base = checkpoint_path(spark, f"streams/{name}-{uuid.uuid4().hex}")
    write_stats_snapshot(PaymentData.from_testdata(spark, sf_dir), f"{base}/stats")
    own = spark.newSession()
    for key, value in {"spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"), **(conf or {})}.items():
        own.conf.set(key, value)
    alerts.open_heartbeats(own, f"{base}/heartbeats")
    for ended in (False, True):
        if ended:
            alerts.write_end(own, f"{base}/heartbeats")
        events = event_stream(own, _events_glob(sf_dir)).unionByName(event_stream(own, f"{base}/heartbeats"))
        stream = build(transaction_stream(events), own.read.parquet(f"{base}/stats"))
        run_to_parquet(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_hourly_alerts_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 over a test-data folder: all hourly windows, from the state alone."""
    return run_to_end(spark, "hourly", sf_dir, hourly_alert_stream)


def stream_rule_episodes_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 over a test-data folder: one alert per rule and cooldown, from the state alone."""
    return run_to_end(spark, "episodes", sf_dir, alerts.rule_episode_stream, {alerts.LOCAL_MERGE: "true"})


def _events_glob(sf_dir: str) -> str:
    # a file stream source lists a folder or a glob; this glob names the one file
    return f"{sf_dir.rstrip('/')}/event[s].parquet"

