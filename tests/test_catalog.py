"""Schemas, published tables and the staging clean-up."""
from payment_helpers import SF_SMALL
from ledgerlens.plans import catalog, ingest


def test_publish_and_verify(spark):
    loaded = ingest.loaded_from_testdata(spark, SF_SMALL)
    catalog.create_schemas(spark)
    assert sorted(r.schema_name for r in catalog.verify_schemas(spark).collect()) == sorted(catalog.SCHEMAS)
    catalog.publish(loaded)
    catalog.publish(loaded)  # rerun: overwrite, same counts
    counts = {t: spark.table(t).count() for t in catalog.TABLES.values()}
    assert counts == {"staging.raw_creditcard": 1003, "analytics.transactions": 1003,
                      "fraud_detection.fraud_cases": 1004}
    again = catalog.read_published(spark)
    assert {r.table_name: r.row_count for r in ingest.validate_counts(again).collect()}["analytics.transactions"] == 1003
    catalog.truncate_staging(spark)
    assert spark.table("staging.raw_creditcard").count() == 0
    catalog.drop_staging(spark)
    assert not spark.catalog.tableExists("staging.raw_creditcard")
