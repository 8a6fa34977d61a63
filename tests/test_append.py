"""Appending files: repeated, failed, corrected and empty batches."""
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import append
from ledgerlens.schema import STAGING

ZEROS = [Decimal(0)] * 27


def staging(spark, rows):
    return spark.createDataFrame([(t, Decimal(v), *ZEROS, Decimal(a), c) for t, v, a, c in rows], STAGING)


def tables(spark, path):
    loaded = append.read_appended(spark, path)
    tx = sorted((r.transaction_id, r.batch_id, r.transaction_time, str(r.amount)) for r in loaded.transactions.collect())
    cases = sorted((r.case_id, r.batch_id, r.transaction_id, r.is_fraud) for r in loaded.fraud_cases.collect())
    return tx, cases, sorted((r.batch_id, r.time_seconds) for r in loaded.staging.collect())


DAY1 = [(20, 1, "5.00", 0), (10, 2, "7.00", 1), (10, 2, "7.00", 1)]
DAY2 = [(5, 1, "9.00", 0), (6, 3, "1.00", None)]


def test_repeating_a_batch_changes_nothing(spark, scratch):
    for path, batches in ((f"{scratch}/once", "ab"), (f"{scratch}/again", "aaba")):
        for b in batches:
            append.append_batch(staging(spark, DAY1 if b == "a" else DAY2), path, b, as_of="2024-01-01")
    once = tables(spark, f"{scratch}/once")
    assert once == tables(spark, f"{scratch}/again")
    assert once[0] == [(1, "a", 10, "7.00"), (2, "a", 10, "7.00"), (3, "a", 20, "5.00"), (4, "b", 5, "9.00"), (5, "b", 6, "1.00")]
    assert [(c, t) for c, _, t, _ in once[1]] == [(i, i) for i in range(1, 6)]
    assert append.read_ledger(spark, f"{scratch}/again").count() == 2


def test_a_load_that_failed_half_way_is_invisible_and_repeats(spark, scratch, monkeypatch):
    append.append_batch(staging(spark, DAY1), scratch, "a", as_of="2024-01-01")
    before = tables(spark, scratch)
    with monkeypatch.context() as m:
        m.setattr(append, "PARTS", ("staging", "transactions", "nowhere"))
        with pytest.raises(KeyError):
            append.append_batch(staging(spark, DAY2), scratch, "b", as_of="2024-01-01")
    assert tables(spark, scratch) == before  # its transactions are written, but it is not in the ledger
    done = append.append_batch(staging(spark, DAY2), scratch, "b", as_of="2024-01-01")
    assert done.loaded and done.first_transaction_id == 4
    assert [t[0] for t in tables(spark, scratch)[0]] == [1, 2, 3, 4, 5]


def test_known_key_with_other_rows(spark, scratch):
    append.append_batch(staging(spark, DAY1), scratch, "a", as_of="2024-01-01")
    with pytest.raises(ValueError, match="other rows"):
        append.append_batch(staging(spark, DAY2), scratch, "a")
    append.append_batch(staging(spark, DAY2), scratch, "a", as_of="2024-01-01", replace=True)
    tx, cases, _ = tables(spark, scratch)
    assert [(i, t) for i, _, t, _ in tx] == [(4, 5), (5, 6)] and len(cases) == 2  # ids are not handed out twice


def test_order_of_rows_is_no_other_content(spark, scratch):
    append.append_batch(staging(spark, DAY1), scratch, "a")
    assert not append.append_batch(staging(spark, DAY1[::-1]).repartition(3), scratch, "a").loaded


def test_empty_batch_and_bad_key(spark, scratch):
    append.append_batch(staging(spark, []), scratch, "none", as_of="2024-01-01")
    append.append_batch(staging(spark, DAY2), scratch, "b", as_of="2024-01-01")
    assert [t[0] for t in tables(spark, scratch)[0]] == [1, 2]
    with pytest.raises(ValueError):
        append.append_batch(staging(spark, DAY1), scratch, "../x")
    with pytest.raises(ValueError):
        append.read_appended(spark, scratch + "/nothing")


def test_reading_prunes_to_loaded_batches(spark, scratch):
    for b, rows in (("a", DAY1), ("b", DAY2)):
        append.append_batch(staging(spark, rows), scratch, b, as_of="2024-01-01")
    one = append.read_appended(spark, scratch).transactions.where(F.col("batch_id") == "b")
    assert one.count() == 2 and all("batch_id=b" in f for f in one.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])


def test_a_batch_is_stored_once(spark, scratch):
    # a first delivery is written to its own folder only, and a repeated one is not written at all
    for _ in range(2):
        append.append_batch(staging(spark, DAY1), scratch, "a", as_of="2024-01-01")
    import os
    assert not os.path.exists(f"{scratch}/incoming")
    assert len(tables(spark, scratch)[2]) == len(DAY1)
