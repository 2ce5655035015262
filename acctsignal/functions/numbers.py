"""Flags and rates."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(value: Column) -> Column:
    """0 for NULL, false or 0, otherwise 1."""
    return F.coalesce(value.cast("int") != 0, F.lit(False)).cast("int")


def rate(numerator: Column, denominator: Column) -> Column:
    """Double quotient, NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
