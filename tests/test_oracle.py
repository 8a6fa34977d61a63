"""Every registered query against its DuckDB oracle on the smallest fixture."""
from collections import Counter

import duckdb
import pytest

from payment_helpers import SF_SMALL

import __spark_entry__ as entry
from ledgerlens.plans.registry import QUERIES
from ledgerlens.sources.testdata import TABLES

ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["detection_method", "total_flagged", "fraud_caught", "false_positives",
                          "precision_percentage", "recall_percentage"]
    assert df.count() == 3


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = sdf.collect()
    rel = duck.sql(ORACLE[name])
    drows = rel.fetchall()
    assert sdf.columns == rel.columns
    norm = lambda rows: Counter(tuple(f"{type(v).__name__}:{v}" for v in r) for r in rows)
    assert norm(srows) == norm(drows)
