"""Alerts from stream state: cooldown, late rows, restart, and the end of a source."""
import datetime as dt

import pytest

from ledgerlens import constants as C
from ledgerlens.schema import EVENTS
from ledgerlens.streaming import alerts, score

BLOCK, MONITORED, QUIET = 499 * 4, 125, 2  # event ids whose V3 is -52 with a pattern amount, -45, and small


def at(hour, minute=0, day=1):
    return dt.datetime(2024, 1, day, hour, minute)


@pytest.fixture
def folder(spark, scratch):
    alerts.open_heartbeats(spark, f"{scratch}/beats")
    spark.createDataFrame([(0.0, 1.0)], "_mean_v3 double, _sd_v3 double").write.parquet(f"{scratch}/stats")
    return scratch


def arrive(spark, folder, part, rows):
    spark.createDataFrame([(i, ts, 1, "click", 10.0, "{}") for i, ts in rows], EVENTS).coalesce(1).write.parquet(f"{folder}/in/part={part}")


def run(spark, folder, build, name="out", **options):
    own = spark.newSession()
    own.conf.set(alerts.LOCAL_MERGE, "true")
    events = score.event_stream(own, f"{folder}/in/*", 1).unionByName(score.event_stream(own, f"{folder}/beats"))
    stream = build(score.transaction_stream(events), own.read.parquet(f"{folder}/stats"), **options)
    query = score.run_to_parquet(stream, f"{folder}/{name}", f"{folder}/{name}-checkpoint")
    query.awaitTermination()
    return sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{folder}/{name}").collect())), query


def episodes(spark, folder, **options):
    rows, query = run(spark, folder, alerts.rule_episode_stream, cooldown="2 hours", **options)
    return [(rule, first[11:16], last[11:16], hits) for rule, first, last, hits, *_ in rows], query


def test_one_alert_per_rule_and_cooldown(spark, folder):
    watch = C.ACTION_MONITOR
    arrive(spark, folder, 0, [(MONITORED, at(1)), (MONITORED, at(2, 30)), (MONITORED, at(4, 30)),  # exactly the cooldown: the same
                              (BLOCK, at(3)), (MONITORED, at(6, 31)), (QUIET, at(5))])
    alerts.write_end(spark, f"{folder}/beats")
    got, _ = episodes(spark, folder)
    assert got == sorted([(watch, "01:00", "04:30", 3), (watch, "06:31", "06:31", 1), (C.ACTION_BLOCK, "03:00", "03:00", 1)])


def test_open_episodes_wait_for_the_watermark_or_the_end(spark, folder):
    arrive(spark, folder, 0, [(MONITORED, at(1)), (MONITORED, at(2))])
    assert episodes(spark, folder)[0] == []
    # rows that no rule picks move the watermark (to 08:00): the episode closes, and a late hit is dropped
    arrive(spark, folder, 1, [(QUIET, at(9))])
    assert episodes(spark, folder)[0] == [(C.ACTION_MONITOR, "01:00", "02:00", 2)]
    arrive(spark, folder, 2, [(MONITORED, at(1, 30)), (MONITORED, at(10))])
    got, query = episodes(spark, folder)
    assert got == [(C.ACTION_MONITOR, "01:00", "02:00", 2)]
    assert sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"]) == 1
    # the restarted query goes on from its state, and the end closes what is open, once
    alerts.write_end(spark, f"{folder}/beats")
    whole = [(C.ACTION_MONITOR, "01:00", "02:00", 2), (C.ACTION_MONITOR, "10:00", "10:00", 1)]
    assert episodes(spark, folder)[0] == whole
    assert episodes(spark, folder)[0] == whole


def test_an_episode_is_found_over_several_files_and_orders(spark, folder):
    for part, hour in enumerate((3, 1, 2)):
        arrive(spark, folder, part, [(MONITORED, at(hour))])
    assert episodes(spark, folder, delay="12 hours")[0] == []  # all files are taken before the end is written
    alerts.write_end(spark, f"{folder}/beats")
    assert episodes(spark, folder, delay="12 hours")[0] == [(C.ACTION_MONITOR, "01:00", "03:00", 3)]


def test_the_end_closes_hourly_windows_from_the_state(spark, folder):
    arrive(spark, folder, 0, [(QUIET, at(1, 10)), (QUIET, at(1, 20)), (QUIET, at(5, day=2))])
    before, _ = run(spark, folder, score.hourly_alert_stream)
    assert [r[2] for r in before] == [2]  # the last window is open
    alerts.write_end(spark, f"{folder}/beats")
    after, _ = run(spark, folder, score.hourly_alert_stream)
    assert [(r[0][:13], r[2]) for r in after] == [("2024-01-01 01", 2), ("2024-01-02 05", 1)]


def test_a_source_without_rows_ends(spark, folder):
    arrive(spark, folder, 0, [])
    alerts.write_end(spark, f"{folder}/beats")
    assert episodes(spark, folder)[0] == []
