"""Exceptions. Problems of a schema or an argument are raised when a plan is built; problems of a value when it runs.

What a running plan raises is an exception of Spark; inside ``typed_errors`` it comes out as the class of this module.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager


class RollweaveError(Exception):
    """Base of all errors of this package."""


class YearGroupError(RollweaveError):
    """A year group that can't be understood or is out of range."""


class FurtherEducationError(YearGroupError):
    """A further-education level, which has no school year group."""


class PostcodeError(RollweaveError):
    """A postcode of the wrong form."""


#: How plans begin the message of a bad value, and the class that stands for it.
BAD_POSTCODE, FURTHER_EDUCATION = "not the form of a postcode: ", "a further-education level has no year group: "
BAD_YEAR_GROUP, PAST_SCHOOL = "not a year group (R or 0-13): ", "not a school year: "
_VALUE_ERRORS = {BAD_POSTCODE: PostcodeError, FURTHER_EDUCATION: FurtherEducationError, BAD_YEAR_GROUP: YearGroupError, PAST_SCHOOL: YearGroupError}


@contextmanager
def typed_errors() -> Iterator[None]:
    """Run actions in this block to catch PostcodeError, YearGroupError and FurtherEducationError by their classes."""
    from pyspark.errors import PySparkException

    try:
        yield
    except PySparkException as e:
        for begin, kind in _VALUE_ERRORS.items():
            if found := re.search(re.escape(begin) + ".*", str(e)):
                raise kind(found[0]) from e
        raise


class MissingColumnError(RollweaveError):
    """A column that a table doesn't have."""


class RowIdentityError(RollweaveError):
    """An id that should be unique isn't."""


class FilterMismatchError(RollweaveError):
    """Blocking columns of the two sides don't pair up."""


class ColumnClashError(RollweaveError):
    """Column names that aren't unique."""


def need_columns(df, columns, what: str) -> None:
    """Exact names, though Spark itself resolves them without regard to case."""
    for c in columns:
        if c not in df.columns:
            raise MissingColumnError(f"{what} has no column {c!r}")


def need_frame(df, what: str) -> None:
    from pyspark.sql import DataFrame

    if not isinstance(df, DataFrame):
        raise TypeError(f"{what} must be a Spark DataFrame, not {type(df).__name__}")


def need_mode(errors: str, *allowed: str) -> None:
    if errors not in (allowed or ("raise", "ignore", "coerce")):
        raise ValueError(f"errors must be one of {', '.join(allowed or ('raise', 'ignore', 'coerce'))}, not {errors!r}")
