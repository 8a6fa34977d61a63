"""Percent ranks and percentiles against their definitions, with hot values and large groups."""
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.quantiles import exact_percentiles
from ledgerlens.operators.ranks import with_percent_ranks

EXACT = [("p0", Decimal("0")), ("p50", Decimal("0.5")), ("p95", Decimal("0.95")), ("p99", Decimal("0.99")), ("p100", Decimal("1"))]


def frame(spark, values, parts=7):
    return spark.createDataFrame([(i, None if v is None else Decimal(v)) for i, v in enumerate(values)], "id long, amount decimal(10,2)").repartition(parts)


def test_percent_ranks_match_the_window(spark):
    rng = random.Random(3)
    values = [7] * 400 + [rng.randrange(500) for _ in range(800)]
    df = frame(spark, values)
    df.createOrReplaceTempView("ranked_rows")
    want = spark.sql("SELECT id, CAST(round(CAST(percent_rank() OVER (ORDER BY amount) * 100 AS DECIMAL(38,12)), 2) AS DECIMAL(18,2)) AS pct FROM ranked_rows")
    got = with_percent_ranks(df, "amount", "pct").select("id", "pct")
    assert dict(got.collect()) == dict(want.collect())


def test_percent_ranks_of_few_rows(spark):
    assert [r.pct for r in with_percent_ranks(frame(spark, [5]), "amount", "pct").collect()] == [Decimal("0.00")]
    assert with_percent_ranks(frame(spark, []), "amount", "pct").collect() == []
    got = {r.id: r.pct for r in with_percent_ranks(frame(spark, [5, None, 5, 9]), "amount", "pct").collect()}
    assert got == {0: 0, 2: 0, 3: Decimal("66.67"), 1: 100}  # NULL is the largest


def test_ranks_move_no_rows_to_one_partition(spark):
    """Only the offsets, a row per range, meet in one task."""
    df = with_percent_ranks(spark.range(5000).select((F.col("id") % 900).alias("x")), "x", "pct")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 2 and "Window [sum(_c" in plan


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_percentiles_against_sorting(spark, accuracy):
    """With a coarse sketch the brackets must still hold the ranks."""
    rng = random.Random(accuracy)
    values = [Decimal(rng.randrange(200_000)).scaleb(-2) for _ in range(4000)] + [Decimal("3.33")] * 2500 + [None] * 9
    df = frame(spark, values)
    got = exact_percentiles(df, "amount", EXACT, accuracy=accuracy).collect()[0]
    held = sorted(v for v in values if v is not None)
    for name, p in EXACT:
        at = (len(held) - 1) * p
        lo, hi = held[int(at)], held[math.ceil(at)]
        assert got[name] == lo + (hi - lo) * (at - int(at)), name


def test_percentiles_per_group(spark):
    rng = random.Random(8)
    rows = [(g, Decimal(rng.randrange(10_000)).scaleb(-2)) for g, n in (("hot", 3000), ("b", 40), ("c", 1), (None, 7)) for _ in range(n)] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, amount decimal(10,2)").repartition(5)
    got = {r.g: r for r in exact_percentiles(df, "amount", EXACT, by=["g"], accuracy=50).collect()}
    assert set(got) == {"hot", "b", "c", None}
    for g, row in got.items():
        held = sorted(v for k, v in rows if k == g and v is not None)
        for name, p in EXACT:
            at = (len(held) - 1) * p
            assert row[name] == held[int(at)] + (held[math.ceil(at)] - held[int(at)]) * (at - int(at)), (g, name)
