"""Field updates that a master record needs: ``Column`` expressions, all fields in one pass."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import need_columns, need_frame
from ..functions.text import SPACE
from ..log import get_logger

logger = get_logger(__name__)


def _sides(df: DataFrame, new: str, old: str) -> tuple[Column, Column, bool]:
    """(new value as it may be returned, whether it differs, whether it is text)."""
    need_frame(df, "df")
    for c in (new, old):
        if not isinstance(c, str):
            raise TypeError(f"a column name must be a string, not {type(c).__name__}")
    need_columns(df, [new, old], "the table")
    a, b = df.schema[new].dataType, df.schema[old].dataType
    left, right = F.col(f"`{new}`"), F.col(f"`{old}`")
    if a != b:
        logger.warning("type mismatch: %s is %s, but %s is %s", new, a.simpleString(), old, b.simpleString())
        if not (isinstance(a, T.NumericType) and isinstance(b, T.NumericType)):
            left, right = left.cast("string"), right.cast("string")
    changed = ~left.eqNullSafe(right)
    value = F.col(f"`{new}`")
    if isinstance(a, T.StringType):
        value = F.when(~value.rlike(f"^{SPACE}*$"), value)  # a blank never overwrites anything
    return value, changed, isinstance(a, T.StringType)


def get_updates(df: DataFrame, new: str, old: str) -> Column:
    """The new value where it differs from the old one and isn't blank, else null."""
    value, changed, _ = _sides(df, new, old)
    return F.when(changed, value)


def get_contextual_updates(df: DataFrame, new: str, old: str, bad_values: Iterable) -> Column:
    """Like ``get_updates``, but values listed as bad (as they stand, untrimmed) never overwrite anything."""
    if isinstance(bad_values, str) or not isinstance(bad_values, Iterable):
        raise TypeError("bad_values must be a list, set or other collection, not one string")
    value, changed, _ = _sides(df, new, old)
    bad = [v for v in bad_values if v is not None]
    good = ~F.col(f"`{new}`").isin(bad) if bad else F.lit(True)
    return F.when(changed & good, value)


def with_updates(df: DataFrame, pairs: dict[str, str] | Iterable[str], bad_values: dict[str, Iterable] | None = None, prefix: str = "HEAT: ", result: str = "Update: ") -> DataFrame:
    """``df`` with an ``Update: x`` column for each pair (new, old), or for each name against its prefixed one."""
    pairs = pairs if isinstance(pairs, dict) else {c: prefix + c for c in pairs}
    bad = bad_values or {}
    return df.withColumns({result + n: get_contextual_updates(df, n, o, bad[n]) if n in bad else get_updates(df, n, o) for n, o in pairs.items()})
