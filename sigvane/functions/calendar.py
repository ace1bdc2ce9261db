"""Calendar quarters and date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigvane.functions.text import is_missing


def quarter_label(c: Column) -> Column:
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def quarter_start(label: Column) -> Column:
    year = F.substring(label, 1, 4).try_cast("int")
    quarter = F.substring(label, 6, 1).try_cast("int")
    return F.make_date(year, (quarter - 1) * 3 + 1, F.lit(1))


def shift_quarter(label: Column, periods: int = 1) -> Column:
    return quarter_label(F.add_months(quarter_start(label), 3 * periods))


def quarter_end(c: Column) -> Column:
    return F.date_sub(F.add_months(F.trunc(c.cast("date"), "quarter"), 3), 1)


def parse_timestamp(c: Column) -> Column:
    return c.try_cast("timestamp")


def parse_date(c: Column) -> Column:
    return c.try_cast("timestamp").cast("date")


def parse_optional_date(c: Column) -> Column:
    return F.when(~is_missing(c), parse_date(c))
