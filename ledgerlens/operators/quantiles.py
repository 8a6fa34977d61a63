"""Exact continuous percentiles by selection.

``percentile_cont(p)`` (and Spark's exact ``percentile``) keep every value of
a group in one task's memory; for a global percentile that is the whole table.
Here a mergeable sketch (``percentile_approx``, one small state per task and
group) first brackets each percentile: its answers are off by at most
1/accuracy of the rows, so the values it gives two such steps below and above p
enclose the ranks floor and ceil of (n-1)*p. One exact pass then counts the rows
below each bracket, another the distinct values inside it (map-side combined),
and only those are put in order, a window per group and percentile. The result
is interpolated in exact decimal arithmetic: v_lo + (v_hi - v_lo) * frac.

A group of at most ``accuracy`` rows is its own bracket. A group that holds a
third of all rows is one sketch state a task and one row to join the brackets
with.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rows of the sketch: its ranks are off by at most 1/ACCURACY of the group
ACCURACY = 10_000


def exact_percentiles(df: DataFrame, value: str, percentiles: Sequence[tuple[str, Decimal]], by: Sequence[str] = (),
                      accuracy: int = ACCURACY) -> DataFrame:
    """A column per ``(name, p)``: the continuous percentile p of ``value``
    (NULLs ignored), in one row, or in a row per group of ``by``; NULL for an
    empty input (no row for a group without values)."""
    by = list(by)
    rows = df.select(*by, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    kind = rows.schema["_v"].dataType
    out_type = T.DecimalType(38, min(38, kind.scale + 4)) if isinstance(kind, T.DecimalType) else T.DoubleType()
    step = 2.0 / accuracy
    edges = [e for _, p in percentiles for e in (max(0.0, float(p) - step), min(1.0, float(p) + step))]
    sketch = rows.groupBy(*by).agg(
        F.percentile_approx("_v", edges, accuracy).alias("_cuts"), F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    small = F.col("_n") <= accuracy

    def bracket(i: int, name: str, p: Decimal):
        at = (F.col("_n") - 1).cast("decimal(20,0)") * F.lit(Decimal(p)).cast("decimal(7,6)")
        return F.struct(F.lit(name).alias("_name"), F.floor(at).cast("long").alias("_first"), F.ceil(at).cast("long").alias("_last"),
                        (at - F.floor(at)).alias("_frac"), F.when(small, F.col("_min")).otherwise(F.col("_cuts")[2 * i]).alias("_lo"),
                        F.when(small, F.col("_max")).otherwise(F.col("_cuts")[2 * i + 1]).alias("_hi"))

    brackets = sketch.where("_n > 0").select(*[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)],
                                             F.array(*[bracket(i, n, p) for i, (n, p) in enumerate(percentiles)]).alias("_brackets"))
    groups = [f"_by{k}" for k in range(len(by))]
    if by:
        match = [F.col(b).eqNullSafe(F.col(g)) for b, g in zip(by, groups)]
        placed = rows.join(brackets, match).select(*groups, "_v", "_brackets")
    else:
        placed = rows.crossJoin(F.broadcast(brackets))  # one row
    # one pass: a row counts below every bracket above it, and stays with its value inside the others
    each = placed.select(*groups, "_v", F.explode(F.filter("_brackets", lambda b: F.col("_v") <= b["_hi"])).alias("_b"))
    inside = F.col("_v") >= F.col("_b._lo")
    counts = each.select(*groups, F.col("_b").alias("_b"), F.when(inside, F.col("_v")).alias("_v")).groupBy(*groups, "_b", "_v").agg(
        F.count(F.lit(1)).alias("_c"))
    # the rows below a bracket have one NULL value, which sorts first
    upto = Window.partitionBy(*groups, "_b").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = counts.withColumn("_upto", F.sum("_c").over(upto)).where(F.col("_v").isNotNull())
    start, end = F.col("_upto") - F.col("_c"), F.col("_upto")

    def at_rank(rank: str):
        return F.max(F.when((F.col(rank) >= start) & (F.col(rank) < end), F.col("_v")))

    picked = found.groupBy(*groups, "_b").agg(at_rank("_b._first").alias("_x"), at_rank("_b._last").alias("_y"))
    one = [F.max(F.when(F.col("_b._name") == name, F.col("_x") + (F.col("_y") - F.col("_x")) * F.col("_b._frac"))).cast(out_type).alias(name)
           for name, _ in percentiles]
    return picked.groupBy(*[F.col(g).alias(b) for g, b in zip(groups, by)]).agg(*one)
