"""Null-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """Double, null where the text is no number; NaN counts as missing."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def safe_log(c: Column) -> Column:
    return F.when(c > 0, F.log(c))


def safe_return(start: Column, end: Column) -> Column:
    return F.try_divide(end, start) - 1


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def safe_difference(end: Column, start: Column) -> Column:
    return end - start


def normalize_margin(c: Column) -> Column:
    """Ratios stay, values above one are percentages."""
    number = to_number(c)
    return F.when(number > 1, number / 100).otherwise(number)


def margin_is_invalid(c: Column) -> Column:
    return (to_number(c) < 0) | (normalize_margin(c) > 1)


def is_whole_score(c: Column) -> Column:
    number = to_number(c)
    return (number % 1 == 0) & number.between(1, 5)


def mean_of(columns: list[str]) -> Column:
    total = F.col(columns[0]).cast("double")
    for name in columns[1:]:
        total = total + F.col(name)
    return total / len(columns)


def finite(c: Column) -> Column:
    """Infinite and NaN to null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
