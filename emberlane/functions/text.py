"""Text cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_box(number: Column, width: int = 4) -> Column:
    """Zero-pad box numbers of 1..width characters; any other length is NULL."""
    return F.when(F.length(number).between(1, width), F.lpad(number, width, "0"))


def pad_box_keep(number: Column, width: int = 4) -> Column:
    """Zero-pad box numbers of 1..width-1 characters; any other length is kept."""
    return F.when(F.length(number).between(1, width - 1), F.lpad(number, width, "0")).otherwise(number)


def drop_first_char(text: Column) -> Column:
    return F.substring(text, 2, 2**31 - 1)


def split_sum(text: Column, separator: str = ";") -> Column:
    """Sum of the numbers in a separated list.

    Parts that are no number add nothing; a NULL list stays NULL; an empty one is 0.
    """
    part_value = lambda part: F.coalesce(F.nanvl(part.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.aggregate(F.split(text, f"\\Q{separator}\\E"), F.lit(0.0), lambda total, part: total + part_value(part))


def box_key(number: Column) -> Column:
    """Integer join key of a box number; text that is no integer is NULL."""
    return number.try_cast("int")
