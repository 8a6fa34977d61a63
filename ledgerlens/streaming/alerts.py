"""Alerts from state: one per rule and cooldown, and the end of a source.

An alert is not one per transaction. The transactions that a rule picks are
gathered into episodes: hits of the same rule that lie no further apart than the
cooldown belong together, and an episode is one alert, emitted once the watermark
has passed its last hit by the cooldown. The state is one session row per open
episode. Sessions are merged inside each input partition before the shuffle
(``LOCAL_MERGE``), so a rule that picks a third of all rows moves its sessions of
each partition, not its rows.

A window or an episode closes when the watermark passes it, and the watermark only
moves with event times, so what is open when a source stops would stay in the
state. ``write_end`` puts a heartbeat row, without a transaction and later than any
event, into a folder of its own that the stream reads beside the events: the
watermark passes everything open, and the state emits it. Nothing is computed by a
second, batch way. Rows read after the heartbeat are late and dropped, so it is
written once the stream has taken all files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.numeric import half_up_round
from ..operators.stats import zscore
from ..plans.detect import pattern_action
from ..schema import EVENTS

#: the time of the heartbeat that ends a source
END_OF_SOURCE = "9999-01-01 00:00:00"
LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def open_heartbeats(spark: SparkSession, folder: str) -> None:
    """Make the heartbeat folder, without a heartbeat yet."""
    spark.createDataFrame([], EVENTS).write.mode("append").parquet(folder)


def write_end(spark: SparkSession, folder: str) -> None:
    """End the source: no event comes after this."""
    ends = F.lit(END_OF_SOURCE).cast(EVENTS["ts"].dataType)
    row = [ends.alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENTS.fields]
    spark.range(1).select(*row).write.mode("append").parquet(folder)


def is_heartbeat(event_time: Column) -> Column:
    return event_time >= F.timestamp_seconds(F.unix_timestamp(F.lit(END_OF_SOURCE).cast("timestamp_ntz")))


def rule_episode_stream(transactions: DataFrame, stats: DataFrame, delay: str = "1 hour", cooldown: str = "12 hours",
                        watch_z: float = C.MONITOR_V3_Z) -> DataFrame:
    """One row per rule and episode: first and last hit, hits, volume and the largest score.

    A row counts for the first rule that fits it, as in the batch reports. Hits
    exactly one cooldown apart are the same episode.
    """
    from .score import utc_text

    scored = (transactions.crossJoin(F.broadcast(stats)).withColumn("v3_z", zscore("v3"))
              .withWatermark("event_time", delay)
              # the event time in the condition keeps it above the watermark: rows that no rule picks move it too
              .where((F.col("v3_z") > F.lit(watch_z)) | is_heartbeat(F.col("event_time"))))
    return (
        scored.groupBy(pattern_action(F.col("v3_z"), F.col("amount")).alias("rule"), F.session_window("event_time", cooldown).alias("_open"))
        .agg(F.max("event_time").alias("_last"), F.count("transaction_id").alias("hits"), F.sum("amount").alias("volume"), F.max("v3_z").alias("_z"))
        .select("rule", utc_text(F.col("_open.start")).alias("first_hit"), utc_text(F.col("_last")).alias("last_hit"), "hits", "volume",
                half_up_round(F.col("_z"), 2).alias("max_risk_score"))
    )
