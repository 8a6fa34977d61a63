"""Confusion counts of several detectors in one pass.

A detector comparison written as one SELECT per detector joined by UNION ALL
reads the fact table once per detector. Here every detector is a predicate
column, all counts are conditional aggregates of one global aggregation
(partial per partition, one tiny final merge), and the single result row is
turned into one row per detector with ``inline`` — one scan for any number
of detectors or thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up_ratio


def confusion_sweep(
    df: DataFrame,
    detectors: Sequence[tuple[str, Column]],
    truth: Column,
    label_name: str = "detector",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Columns: <label_name>, detector_order, flagged, caught, false_positives.

    ``flagged`` counts rows whose predicate is TRUE (NULL counts as not
    flagged), ``caught`` those also with ``truth`` TRUE, ``false_positives``
    those with ``truth`` FALSE (a NULL truth is in neither). ``carry`` names
    columns with one value for all rows (of a broadcast row) to keep.
    """
    aggs = []
    for i, (_, pred) in enumerate(detectors):
        aggs += [
            F.count_if(pred).alias(f"_f{i}"),
            F.count_if(pred & truth).alias(f"_c{i}"),
            F.count_if(pred & ~truth).alias(f"_p{i}"),
        ]
    one_row = df.agg(*aggs, *[F.first(c).alias(c) for c in carry])
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias(label_name),
                F.lit(i + 1).alias("detector_order"),
                F.col(f"_f{i}").alias("flagged"),
                F.col(f"_c{i}").alias("caught"),
                F.col(f"_p{i}").alias("false_positives"),
            )
            for i, (label, _) in enumerate(detectors)
        ]
    )
    return one_row.select(*carry, F.inline(rows))


def precision_pct(caught: Column, flagged: Column, scale: int = 2) -> Column:
    """caught·100/flagged rounded half up; NULL when nothing is flagged."""
    return half_up_ratio(caught, flagged, scale, factor=100)
