"""Turn one aggregate row into a few report rows.

A report of n labelled rows is written as n SELECTs joined by UNION ALL in
SQL, each reading the input again. Here the input is aggregated once and the
single row is turned into n rows with ``inline`` over an array of structs
(a narrow Generate, no extra scan).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def rows_from_one(one: DataFrame, names: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """``rows`` are tuples of Columns or literals, one value per name."""
    structs = [F.struct(*[_col(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return one.select(F.inline(F.array(*structs)))
