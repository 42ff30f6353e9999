"""Rounding for results that are compared across engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lifts a value off a tie between two roundings, where the last bit of a double would decide.
NUDGE = 1.00000000001


def settled(column: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(column) if isinstance(column, str) else column) * NUDGE, digits)


def settled_cells(column: str, digits: int = 6) -> Column:
    """As ``settled``, of very many values: those of up to nine places before the point are rounded as doubles, which takes
    a seventh of the time."""
    value, unit = F.col(column) * NUDGE, float(10**digits)
    return F.when(F.abs(value) < 1e9, F.rint(value * unit) / unit + F.lit(0.0)).otherwise(F.round(value, digits))


def settled_sql(expression: str, digits: int = 6) -> str:
    return f"round(({expression}) * {NUDGE}, {digits})"
