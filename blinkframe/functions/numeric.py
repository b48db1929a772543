"""Column forms of arithmetic whose edge cases matter here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction(value: Column) -> Column:
    """Fractional part with the sign of the value."""
    return value - F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))


def wrapped(value: Column, width: Column) -> Column:
    """Remainder between 0 and ``width``."""
    return F.pmod(value, width)


def at_most(value: Column, limit: float, nan_passes: bool) -> Column:
    """Comparison with the outcome for NaN said outright; NaN is above every number in Spark."""
    return (F.isnan(value) | (value <= limit)) if nan_passes else (~F.isnan(value) & (value <= limit))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
