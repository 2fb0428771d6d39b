"""United Kingdom postcodes: form only, not whether they exist."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BAD_POSTCODE, need_mode
from .text import SPACE, _col

# Fixed value: outward code, a space, inward code.
PATTERN = "^[A-Z]{1,2}[0-9][A-Z0-9]? [0-9][A-Z]{2}$"


def valid_postcode(c: Column | str) -> Column:
    """Whether a text has the form of a formatted postcode; false for null."""
    return F.coalesce(_col(c).rlike(PATTERN), F.lit(False))


def format_postcode(c: Column | str, errors: str = "raise") -> Column:
    """Upper case with one space before the last three characters.

    A wrong form raises when the plan runs (``raise``), stays as it is (``ignore``) or gives null (``coerce``, any type).
    """
    need_mode(errors)
    c = _col(c).cast("string") if errors == "coerce" else _col(c)
    bare = F.upper(F.regexp_replace(c, f"{SPACE}+", ""))
    n = F.length(bare)
    spaced = F.concat(F.substring(bare, F.lit(1), n - 3), F.lit(" "), F.substring(bare, n - 2, F.lit(3)))
    good = n.between(5, 7) & spaced.rlike(PATTERN)
    if errors == "raise":
        bad = F.raise_error(F.concat(F.lit(BAD_POSTCODE), c)).cast("string")
        return F.when(c.isNotNull(), F.when(good, spaced).otherwise(bad))
    return F.when(good, spaced).otherwise(c if errors == "ignore" else F.lit(None).cast("string"))
