"""Ingest: CSV staging, id assignment, the 30-key label join, quality checks."""
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from payment_helpers import SF_SMALL, make_data
from ledgerlens.operators.ids import assign_sequential_ids
from ledgerlens.plans import ingest
from ledgerlens.schema import FEATURES, STAGING
from ledgerlens.sources import fixtures
from ledgerlens.sources.card_csv import read_card_csv, to_staging, write_card_csv
from ledgerlens.sources.testdata import read_table


def test_csv_roundtrip(spark, scratch):
    raw = fixtures.raw_card_file(read_table(spark, SF_SMALL, "events"))
    write_card_csv(raw, f"{scratch}/card")
    back = read_card_csv(spark, f"{scratch}/card")
    assert back.schema == STAGING
    assert back.exceptAll(to_staging(raw)).count() == 0 and to_staging(raw).exceptAll(back).count() == 0


def test_ids_equal_row_number_with_hot_duplicate_group(spark):
    rows = [(t, "x") for t in [5, 3, 3, 9, 1]] + [(7, "hot")] * 40 + [(None, "n")]
    df = spark.createDataFrame(rows, "t int, tag string")
    got = assign_sequential_ids(df, [F.col("t").asc_nulls_first(), F.col("tag")], "id", num_partitions=4)
    ids = [r.id for r in got.collect()]
    assert sorted(ids) == list(range(1, len(rows) + 1))
    expect = df.withColumn("id", F.row_number().over(Window.orderBy(F.col("t").asc_nulls_first(), "tag")))
    assert got.groupBy("t", "tag").agg(F.min("id"), F.max("id")).exceptAll(
        expect.groupBy("t", "tag").agg(F.min("id"), F.max("id"))).count() == 0


def _staging_rows(spark, rows):
    """rows: (time, amount, v1, class, v28) -> staging with the other features 0."""
    out = []
    for t, amount, v1, cls, v28 in rows:
        feats = [Decimal(str(v1))] + [Decimal(0)] * 26 + [None if v28 is None else Decimal(str(v28))]
        out.append((t, *feats, Decimal(str(amount)), cls))
    return spark.createDataFrame(out, STAGING)


def test_label_join_semantics(spark):
    staging = _staging_rows(spark, [
        (1, 10, "0.1", 0, 0),            # plain
        (2, 20, "0.2", 1, 0), (2, 20, "0.2", 1, 0),   # (a) exact duplicates fold
        (3, 30, "0.3", 0, 0), (3, 30, "0.3", 1, 0),   # (b) different class: two cases each
        (4, 40, "0.4", 0, None),         # (c) NULL key: no case
        (5, 50, "0.50000001", 0, 0), (5, 50, "0.50000004", 0, 0),  # (d) equal after rounding
    ])
    loaded = ingest.load_all(staging)
    tx = loaded.transactions.collect()
    assert sorted(r.transaction_id for r in tx) == list(range(1, 9))
    cases = loaded.fraud_cases.collect()
    by_time = {}
    id_time = {r.transaction_id: r.transaction_time for r in tx}
    for c in cases:
        by_time.setdefault(id_time[c.transaction_id], []).append(c.is_fraud)
    assert sorted(by_time[1]) == [False]
    assert sorted(by_time[2]) == [True, True]            # two transactions, one case each
    assert sorted(by_time[3]) == [False, False, True, True]  # two transactions x two cases
    assert 4 not in by_time
    assert sorted(by_time[5]) == [False, False]
    assert {c.detection_method for c in cases} == {"kaggle_labeled"}
    assert {c.fraud_probability for c in cases} == {Decimal("0.9500"), Decimal("0.0500")}


def test_carry_label_equals_join_without_conflicts(spark):
    staging = _staging_rows(spark, [(t, 10 + t, f"0.{t}", t % 2, 0) for t in range(1, 9)])
    tx = ingest.load_transactions(staging, keep_class=True)
    carried = ingest.carry_label(tx)
    joined = ingest.load_fraud_cases(tx.drop("class"), staging)
    assert carried.exceptAll(joined).count() == 0 and joined.exceptAll(carried).count() == 0


def test_expected_ingest_counts(spark):
    loaded = ingest.load_from_testdata(spark, SF_SMALL)
    counts = {r.table_name: r.row_count for r in ingest.validate_counts(loaded).collect()}
    assert counts == {"staging.raw_creditcard": 1003, "analytics.transactions": 1003,
                      "fraud_detection.fraud_cases": 1004}
    unlabelled = loaded.transactions.join(loaded.fraud_cases, "transaction_id", "left_anti").count()
    assert unlabelled == 1


def test_orphan_case_is_reported(spark):
    data = make_data(spark, [(1, 0, 10), (2, 0, 10)], [(1, True), (99, False)])
    got = {r.check_name: r.row_count for r in ingest.dq_orphans(data).collect()}
    assert got == {"fraud case without transaction": 1, "transaction without fraud case": 1}
    twice = make_data(spark, [(1, 0, 1), (1, 0, 2)], [(1, True), (1, False)])
    cases = ingest.with_case_ids(twice.fraud_cases.selectExpr("*"), "2024-01-01")
    dup = {r.table_name: (r.key_column, r.duplicate_keys, r.rows_with_duplicate_key)
           for r in ingest.dq_unique_key(type(twice)(twice.transactions, cases)).collect()}
    assert dup["analytics.transactions"] == ("transaction_id", 1, 2)
    assert dup["fraud_detection.fraud_cases"] == ("case_id", 0, 0)  # two cases of one transaction are fine
    assert FEATURES[0] == "v1"


def test_case_ids_and_defaults(spark):
    cases = spark.createDataFrame(
        [(3, None, True, "kaggle_labeled", Decimal("0.9500")), (1, None, False, "kaggle_labeled", Decimal("0.0500")),
         (3, None, False, "kaggle_labeled", Decimal("0.0500"))],
        "transaction_id long, customer_id long, is_fraud boolean, detection_method string, "
        "fraud_probability decimal(5,4)")
    rows = sorted(ingest.with_case_ids(cases).collect(), key=lambda r: r.case_id)
    assert [(r.case_id, r.transaction_id, r.is_fraud) for r in rows] == [(1, 1, False), (2, 3, False), (3, 3, True)]
    assert {r.investigation_status for r in rows} == {"pending"}
    assert {r.financial_loss for r in rows} == {Decimal("0.00")}


def test_orphan_rows(spark):
    from ledgerlens.operators.quality import orphan_rows

    children = spark.createDataFrame([(1,), (2,), (9,)], "transaction_id long")
    parents = spark.createDataFrame([(1,), (2,)], "transaction_id long")
    assert [r.transaction_id for r in orphan_rows(children, parents, "transaction_id").collect()] == [9]
