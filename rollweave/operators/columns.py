"""Column names in snake case: a projection, no job."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from ..errors import ColumnClashError, need_frame


#: Where a capitalised word begins, and where a capital follows a small letter or a digit.
_HUMP = re.compile(r"(?<=.)(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])")


def snake_case(name: str) -> str:
    """Humps become underscores, marks go, runs of spaces and underscores become one underscore."""
    split = _HUMP.sub("_", name.strip())
    kept = "".join(c for c in split if c.isspace() or c == "_" or c.isascii() and c.isalnum())
    return re.sub(r"[\s_]+", "_", kept.strip()).lower()


def snake_case_columns(df: DataFrame) -> DataFrame:
    """``df`` with all columns renamed; names that aren't unique before or after are an error."""
    need_frame(df, "df")
    for names, when in ((df.columns, "before"), ([snake_case(c) for c in df.columns], "after")):
        twice = [c for c, n in Counter(names).items() if n > 1]
        if twice:
            raise ColumnClashError(f"columns that aren't unique {when} renaming: {twice}")
    return df.toDF(*names)
