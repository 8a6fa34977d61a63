"""Views merged from the counts of each batch equal those over all rows."""
from decimal import Decimal

import pytest

from ledgerlens.plans import append, view_state, views
from ledgerlens.plans.data import PaymentData
from ledgerlens.schema import STAGING

ZEROS = [Decimal(0)] * 27
DAY1 = [(20, "5.00", 0), (10, "7.00", 1), (10, "7.00", 1), (90000, "600.00", 0)]  # 90,000 s: an hour of the second day
DAY2 = [(5, "9.00", 0), (3700, "1.01", None), (3600, "120.00", 1)]
DAY3 = [(7200, "55.50", 1), (5, "2000.00", 0)]


def load(spark, path, batch, rows, **options):
    staging = spark.createDataFrame([(t, Decimal(1), *ZEROS, Decimal(a), c) for t, a, c in rows], STAGING)
    return append.append_batch(staging, path, batch, as_of="2024-01-01", **options)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr), dict(df.dtypes)


def same_as_rebuilt(spark, path):
    loaded = append.read_appended(spark, path)
    data = PaymentData(loaded.transactions, loaded.fraud_cases)
    assert rows_of(view_state.hourly_stats(spark, path)) == rows_of(views.fraud_hourly_stats(data))
    assert rows_of(view_state.segment_performance(spark, path, "2024-01-02")) == rows_of(views.segment_performance(data, "2024-01-02"))
    assert rows_of(view_state.executive_dashboard(spark, path, "2024-01-02")) == rows_of(views.executive_dashboard(data, "2024-01-02"))


def test_each_batch_is_counted_once_and_the_views_equal_the_rebuild(spark, scratch):
    for batch, rows in (("a", DAY1), ("b", DAY2)):
        load(spark, scratch, batch, rows)
        assert view_state.update(spark, scratch) == [batch]
        same_as_rebuilt(spark, scratch)
    assert view_state.update(spark, scratch) == []
    load(spark, scratch, "a", DAY1)  # a repeated batch is no new one
    assert view_state.update(spark, scratch) == []
    files = " ".join(view_state.hourly_stats(spark, scratch).inputFiles())
    assert "view_state" in files and "transactions" not in files  # history is not read


def test_a_replaced_batch_is_counted_anew(spark, scratch):
    for batch, rows in (("a", DAY1), ("b", DAY2)):
        load(spark, scratch, batch, rows)
    view_state.update(spark, scratch)
    load(spark, scratch, "a", DAY3, replace=True)
    with pytest.raises(ValueError, match="no state"):  # the old counts are not taken for the new rows
        view_state.hourly_stats(spark, scratch)
    assert view_state.update(spark, scratch) == ["a"]
    same_as_rebuilt(spark, scratch)


def test_empty_batches_and_an_update_that_failed(spark, scratch, monkeypatch):
    load(spark, scratch, "none", [])
    assert view_state.update(spark, scratch) == ["none"]
    same_as_rebuilt(spark, scratch)
    load(spark, scratch, "a", DAY1)
    load(spark, scratch, "b", DAY2)
    count = view_state.count_batch

    def fails_at_b(tx, cases, batch, content):
        if batch == "b":
            raise RuntimeError("lost")
        return count(tx, cases, batch, content)

    with monkeypatch.context() as m:
        m.setattr(view_state, "count_batch", fails_at_b)
        with pytest.raises(RuntimeError):
            view_state.update(spark, scratch)
    assert view_state.update(spark, scratch) == ["b"]
    same_as_rebuilt(spark, scratch)
