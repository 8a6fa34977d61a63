"""Exact ratios, half-up rounding and the report text formats.

All helpers build JVM-side Column expressions (no UDFs), so they stay inside
whole-stage codegen.

Ratios are rounded *half away from zero* on the exact quotient: the value
``round(num * factor / den, scale)`` is computed as an integral division
``(2·K·|num| + den) div (2·den)`` with ``K = factor · 10^scale`` on
DECIMAL(38,0) operands, so no intermediate rounding can move a result across
a .5 boundary (Spark's decimal division rounds at a fixed scale first, which
could). Operands must be integral: counts, or money in cents.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CURRENCY

_INT38 = "decimal(38,0)"


def cents(money: Column) -> Column:
    """Money (DECIMAL with 2 places) as an integral DECIMAL(38,0) of cents."""
    return (money * 100).cast(_INT38)


def half_up_ratio(num: Column, den: Column, scale: int, factor: int = 1, precision: int = 18) -> Column:
    """``round(num * factor / den, scale)`` exactly, half away from zero.

    NULL when ``den`` is 0 or NULL (the NULLIF guard of the SQL); num and den
    must be integral. The result type is DECIMAL(precision, scale).
    """
    k = factor * 10**scale
    n = num.cast(_INT38)
    d = den.cast(_INT38)
    # ``div`` on decimals is exact (BigDecimal.divideToIntegralValue), LONG result
    mag = F.call_function("div", F.abs(n) * (2 * k) + F.abs(d), F.abs(d) * 2)
    signed = F.when(F.signum(n) * F.signum(d) < 0, -mag).otherwise(mag)
    unit = F.lit(Decimal(1).scaleb(-scale)) if scale > 0 else F.lit(Decimal(1))
    value = (signed.cast(_INT38) * unit).cast(f"decimal({precision},{scale})")
    return F.when(d != 0, value)


def half_up_round(value: Column, scale: int, precision: int = 18) -> Column:
    """Round a DECIMAL or DOUBLE half away from zero to ``scale`` places.

    A DOUBLE is first cast to DECIMAL(38,12) (shortest-repr exact digits),
    the same route as a PostgreSQL ``double::numeric`` cast.
    """
    return F.round(value.cast("decimal(38,12)"), scale).cast(f"decimal({precision},{scale})")


def pct_text(value: Column, suffix: str = "%") -> Column:
    """``value || '%'``: a DECIMAL keeps its trailing zeros; NULL stays NULL."""
    return F.concat(value.cast("string"), F.lit(suffix))


def money_text(value: Column, scale: int) -> Column:
    """``'€' || ROUND(value, scale)::TEXT`` (half away from zero; NULL stays NULL)."""
    return F.concat(F.lit(CURRENCY), F.round(value, scale).cast("string"))


def money_grouped_text(value: Column, scale: int = 2) -> Column:
    """``'€' || TO_CHAR(value, 'FM999,999,999.00')``: thousands separators and
    fixed decimals. Rounded half away from zero first, because the text
    formatter itself would round half to even."""
    return F.concat(F.lit(CURRENCY), F.format_number(F.round(value, scale), scale))
