"""School year groups of the English system, dates of birth and academic years."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BAD_YEAR_GROUP, FURTHER_EDUCATION, PAST_SCHOOL, need_mode
from .text import _col, strip

# What a reception year is called.
RECEPTION = ("reception", "r", "year r", "rec", "year group r", "y0", "year 0")
TOO_YOUNG = "Student too young for school"


def academic_year_start(day: date | None = None) -> int:
    """Year in which the academic year of a day (today by default) began: September on counts for its own year."""
    day = day or date.today()
    return day.year if day.month >= 9 else day.year - 1


def _start(start_year: int | None) -> int:
    if start_year is None:
        return academic_year_start()
    if isinstance(start_year, bool) or not isinstance(start_year, int):
        raise TypeError(f"start_year must be an int, not {type(start_year).__name__}")
    return start_year


def _year_group(c: Column) -> tuple[Column, Column]:
    """(number or null, whether it is a further-education level). Numbers keep their sign, texts give their first digits."""
    kind, text = F.typeof(c), F.lower(strip(c.cast("string")))
    level = kind.isin("string") & text.contains("level")
    digits = F.try_element_at(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), F.lit(1)).try_cast("int")
    from_text = F.when(text.isin(*RECEPTION), F.lit(0)).otherwise(digits)
    number = c.cast("string").try_cast("double")
    whole = F.when(number == F.floor(number), number.try_cast("int"))
    n = F.when(kind == "string", from_text).when(kind == "boolean", F.lit(None).cast("int")).otherwise(whole)
    return F.when(~F.coalesce(level, F.lit(False)) & n.between(0, 13), n), level


def _or_raise(value: Column, c: Column, level: Column, kind: str) -> Column:
    text = c.cast("string")
    reason = F.when(level, F.concat(F.lit(FURTHER_EDUCATION), text)).otherwise(F.concat(F.lit(BAD_YEAR_GROUP), text))
    return F.when(value.isNotNull() | c.isNull(), value).otherwise(F.raise_error(reason).cast(kind))


def parse_year_group(c: Column | str, errors: str = "raise") -> Column:
    """Year group as a number from 0 (reception) to 13; wrong ones raise at run time or give null."""
    need_mode(errors, "raise", "coerce")
    c = _col(c)
    n, level = _year_group(c)
    return _or_raise(n, c, level, "int") if errors == "raise" else n


def clean_year_group(c: Column | str, errors: str = "raise") -> Column:
    """``Reception`` or ``Year n``; ``ignore`` keeps wrong values as text, ``coerce`` gives null."""
    need_mode(errors)
    c = _col(c)
    n, level = _year_group(c)
    out = F.when(n == 0, F.lit("Reception")).when(n > 0, F.concat(F.lit("Year "), n.cast("string")))
    if errors == "raise":
        return _or_raise(out, c, level, "string")
    return F.coalesce(out, c.cast("string")) if errors == "ignore" else out


def year_group_from_date(c: Column | str, start_year: int | None = None, errors: str = "raise") -> Column:
    """Year group of a date of birth in the academic year that begins in ``start_year`` (the current one by default)."""
    need_mode(errors, "raise", "ignore")
    c, start = _col(c), _start(start_year)
    n = F.lit(start) - F.year(c) - F.when(F.month(c) >= 9, F.lit(5)).otherwise(F.lit(4))
    late = F.lit(None).cast("string") if errors == "ignore" else F.raise_error(F.concat(F.lit(PAST_SCHOOL + "Year "), n.cast("string"))).cast("string")
    return F.when(n == 0, F.lit("Reception")).when(n < 0, F.lit(TOO_YOUNG)).when(n <= 13, F.concat(F.lit("Year "), n.cast("string"))).when(n > 13, late)


def reverse_date(c: Column | str, errors: str = "raise", timestamp: bool = False) -> Column:
    """Day and month exchanged where that is a date. ``timestamp``: the column has a time of day, which stays."""
    need_mode(errors, "raise", "ignore")
    c = _col(c)
    swapped = F.make_date(F.year(c), F.dayofmonth(c), F.month(c))
    if timestamp:
        # a whole number of days moves the date and leaves the time of day
        swapped = F.timestamp_add("DAY", F.datediff(swapped, c.cast("date")), c)
    return F.when(F.dayofmonth(c) <= 12, swapped).otherwise(c)


def dob_range(c: Column | str, start_year: int | None = None, errors: str = "raise") -> Column:
    """Struct (first, last) of the dates of birth of a year group; wrong year groups raise or give nulls."""
    need_mode(errors)
    n = parse_year_group(c, "raise" if errors == "raise" else "coerce")
    s = F.lit(_start(start_year)) - (n + 5)
    return F.struct(F.make_date(s, F.lit(9), F.lit(1)).alias("first"), F.make_date(s + 1, F.lit(8), F.lit(31)).alias("last"))
