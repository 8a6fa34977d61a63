"""Views kept in the catalog: other sessions, replaced tables, joins without exchanges."""
import uuid
from collections import Counter

import pytest

from payment_helpers import SF_SMALL
from ledgerlens.plans import catalog, ingest, view_sql, views
from ledgerlens.plans.data import PaymentData

AS_OF = "2024-02-01 08:00:00"
STAMPED = ("high_risk_transactions", "executive_dashboard", "segment_performance")


@pytest.fixture(scope="module")
def stored(spark):
    prefix = f"t{uuid.uuid4().hex[:8]}_"
    data = PaymentData.from_testdata(spark, SF_SMALL)
    catalog.publish(ingest.Loaded(None, data.transactions, data.fraud_cases), prefix=prefix, buckets=4)
    names = catalog.create_views(spark, prefix, as_of=AS_OF)
    return spark.newSession(), prefix, names, data


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_another_session_reads_all_five_by_name(spark, stored):
    other, prefix, names, data = stored
    other.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    assert names == [f"{prefix}fraud_detection.{v}" for v in view_sql.DEFINITIONS]
    for name, qualified in zip(view_sql.DEFINITIONS, names):
        options = {"as_of": AS_OF} if name in STAMPED else {}
        own = views.VIEW_BUILDERS[name](data, **options)
        found = other.sql(f"SELECT * FROM {qualified}")
        assert found.schema.names == own.schema.names and [f.dataType for f in found.schema] == [f.dataType for f in own.schema]
        assert rows(found) == rows(own)


def test_usual_questions(stored):
    other, prefix, _, _ = stored
    got = other.sql(f"SELECT * FROM {prefix}fraud_detection.high_risk_transactions WHERE recommended_action = 'IMMEDIATE_BLOCK'")
    assert got.count() == 1
    assert other.sql(f"SELECT * FROM {prefix}fraud_detection.fraud_hourly_stats ORDER BY fraud_rate_percentage DESC").count() == 24


def test_join_of_published_tables_moves_nothing(spark, stored):
    _, prefix, _, _ = stored
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        loaded = ingest.Loaded(None, *(spark.table(catalog.qualified(p, prefix)) for p in ("transactions", "fraud_cases")))
        joined = loaded.as_payment_data().labelled
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 1001
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_views_follow_replaced_tables(spark):
    prefix = f"t{uuid.uuid4().hex[:8]}_"
    data = PaymentData.from_testdata(spark, SF_SMALL)
    catalog.publish(ingest.Loaded(None, data.transactions, data.fraud_cases), prefix=prefix, buckets=2)
    catalog.create_views(spark, prefix)
    few = data.transactions.where("transaction_id < 100")
    catalog.publish(ingest.Loaded(None, few, data.fraud_cases), prefix=prefix, buckets=2)
    catalog.create_views(spark, prefix)  # replacing them is allowed
    total = spark.newSession().table(f"{prefix}fraud_detection.executive_dashboard").first().total_transactions
    assert total == few.join(data.fraud_cases, "transaction_id").count()
