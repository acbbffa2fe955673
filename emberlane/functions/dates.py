"""Date and time expressions. Unparseable text becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlane.functions.constants import DATE_FORMAT, DATETIME_FORMAT


def parse_mdy(text: Column) -> Column:
    return F.try_to_date(text, DATE_FORMAT)


def parse_mdy_hms(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(DATETIME_FORMAT))


def epoch_day(date: Column) -> Column:
    """Days since 1970-01-01, the numeric form medians are taken on."""
    return F.unix_date(date)


def weekday_name(moment: Column) -> Column:
    return F.date_format(moment, "EEEE")


def month_name(moment: Column) -> Column:
    return F.date_format(moment, "MMMM")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def year_after(date: Column, year: int) -> Column:
    """``year(date) > year`` as a plain date range, which a scan can skip data with."""
    return date >= F.make_date(F.lit(year + 1), F.lit(1), F.lit(1))
