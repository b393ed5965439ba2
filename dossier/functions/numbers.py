"""Integer-exact arithmetic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even_ratio(total: Column, count: Column) -> Column:
    """total / count rounded to an integer, ties to even; both are non-negative integers."""
    quotient = F.floor(total / count)
    twice = (total - quotient * count) * 2
    up = (twice > count) | ((twice == count) & (quotient % 2 == 1))
    return quotient + F.when(up, 1).otherwise(0)
