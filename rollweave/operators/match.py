"""Linking new records to a register: exact, blocked fuzzy, and school-and-age fuzzy matches.

Every match returns the matched and the remaining rows, so that calls chain from strict to loose. No call runs a job.
Fuzzy matches never compare rows but distinct (block, sorted name) pairs; what they find is joined back to the rows. Row
order has no meaning in Spark, so ties between register rows go to the smallest ``order_by`` (the id by default).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FilterMismatchError, MissingColumnError, need_columns, need_frame
from ..functions import similarity as S
from ..functions.school import dob_range
from ..functions.text import collapse, strip, title
from ..log import get_logger
from .blocks import pairs_in_blocks

logger = get_logger(__name__)

# Names that the reference's results have; all can be changed by arguments.
ID_COLUMN = "Student HEAT ID"
PREFIX = "HEAT: "
MATCH_TYPE = "Match Type"
SCORE = "Fuzzy Score"


#: Ids that a warning names; the rest are counted.
NAMED_IDS = 20


@dataclass(frozen=True)
class Match:
    """Matched and remaining rows; unpacks like a pair."""

    matched: DataFrame
    remaining: DataFrame
    _reused: DataFrame | None = field(default=None, repr=False)
    _id: str | None = field(default=None, repr=False)

    def __iter__(self):
        return iter((self.matched, self.remaining))

    def reused(self) -> DataFrame | None:
        """Register rows that more than one row matched, with their number of matches; a query of its own, run on demand."""
        return self._reused

    def warn(self) -> int:
        """Log how many register rows are matched more than once, with their smallest ids, and return that; nothing is dropped."""
        if self._reused is None:
            return 0
        name = f"`{self._id}`" if self._id in self._reused.columns else None
        n = self._reused.count()
        if n:
            told = ""
            if name:
                first = [r[0] for r in self._reused.select(F.col(name).cast("string").alias("id")).orderBy("id").limit(NAMED_IDS).collect()]
                told = f" ({', '.join(map(str, first))}{', ...' if n > len(first) else ''})"
            logger.warning("%d register record(s) matched more than one row%s; check them before ids are given out", n, told)
        return n

    def counts(self) -> dict[str, int]:
        """Numbers of matched and remaining rows, logged as well; two queries, run on demand."""
        out = {"matched": self.matched.count(), "remaining": self.remaining.count()}
        logger.info("%d row(s) matched, %d remain", out["matched"], out["remaining"])
        return out


def _comparable(a: T.DataType, b: T.DataType) -> bool:
    numbers = (T.NumericType,)
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return a == b or any(isinstance(a, k) and isinstance(b, k) for k in (numbers, times)) or isinstance(a, T.NullType) or isinstance(b, T.NullType)


def _check_pairs(left: DataFrame, right: DataFrame, left_cols, right_cols, empty_ok: bool = False) -> None:
    need_columns(left, left_cols, "the left table")
    need_columns(right, right_cols, "the register")
    if len(left_cols) != len(right_cols) or not (left_cols or empty_ok):
        raise FilterMismatchError(f"{list(left_cols)} and {list(right_cols)} must be as many, and at least one")
    for a, b in zip(left_cols, right_cols):
        if not _comparable(left.schema[a].dataType, right.schema[b].dataType):
            raise TypeError(f"{a!r} ({left.schema[a].dataType.simpleString()}) can't be compared with {b!r} ({right.schema[b].dataType.simpleString()})")


def exact_match(left: DataFrame, register: DataFrame, left_cols: list[str], register_cols: list[str], description: str, verify: bool = False, id_col: str = ID_COLUMN, prefix: str = PREFIX) -> Match:
    """Null-safe equality on pairs of columns: null keys match null keys, register rows without an id don't count.

    Matched: the left columns, ``Match Type`` and the prefixed id, a row for every register row that fits. ``verify`` adds the
    register's other columns, prefixed, and its differently named join columns as they are. An id that several register
    rows have brings all of them. Remaining: each unmatched left row once.
    """
    need_frame(left, "left")
    need_frame(register, "register")
    _check_pairs(left, register, left_cols, register_cols)
    if id_col not in register.columns:
        raise MissingColumnError(f"the register has no column {id_col!r}")
    if id_col in left.columns:
        raise ValueError(f"{id_col!r} is already in the left table; pass rows that aren't matched yet")
    keys = [f"__k{i}" for i in range(len(register_cols))]
    slim = register.where(F.col(f"`{id_col}`").isNotNull()).select(*(F.col(f"`{c}`").alias(k) for c, k in zip(register_cols, keys)), F.col(f"`{id_col}`").alias("__id"))
    on = [left[f"`{c}`"].eqNullSafe(slim[k]) for c, k in zip(left_cols, keys)]
    joined = left.join(slim, on, "inner")
    own = [left[f"`{c}`"] for c in left.columns]
    kind, the_id = F.lit(description).alias(MATCH_TYPE), F.col("__id").alias(prefix + id_col)
    if verify:
        extra = []
        for k, c, b in zip(keys, left_cols, register_cols):
            if c != b:
                extra.append(F.col(k).alias(b if b not in left.columns else f"{b}_match"))
        others = register.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("__id2"), *(F.col(f"`{c}`").alias(prefix + c) for c in register.columns if c != id_col))
        seen = joined.select(*own, *extra, F.col("__id"), kind)
        full = seen.join(others, F.col("__id") == F.col("__id2"), "left").drop("__id2")
        names = [c for c in full.columns if c not in ("__id", MATCH_TYPE) and not c.startswith(prefix)]
        matched = full.select(*(F.col(f"`{c}`") for c in names), the_id, F.col(f"`{MATCH_TYPE}`"), *(F.col(f"`{prefix}{c}`") for c in register.columns if c != id_col))
    else:
        matched = joined.select(*own, kind, the_id)
    remaining = left.join(slim, on, "left_anti")
    reused = joined.groupBy(F.col("__id").alias(id_col)).agg(F.count(F.lit(1)).alias("matches")).where("matches > 1")
    return Match(matched, remaining, reused, id_col)


def _suffix_warning(left: DataFrame, prefix: str) -> None:
    clash = [c for c in left.columns if c.startswith(prefix)]
    if clash:
        logger.warning("left columns %s look like register columns and can't be told from them in the result", clash)


def _best(left: DataFrame, register: DataFrame, left_keys: dict[str, Column], register_keys: dict[str, Column], within: Column | None, left_name: str, register_name: str, threshold: float, order_by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(left with its keys; best: score and register keys of every distinct (left keys, sorted name); rows of the register keys).

    Pairs and the choice among them carry keys and the order of the first register row, never rows of the register.
    """
    keyed = left.withColumns({f"__l_{k}": c for k, c in left_keys.items()} | {"__l_name": S.sorted_tokens(F.col(f"`{left_name}`").cast("string"))})
    l_keys = [f"__l_{k}" for k in left_keys] + ["__l_name"]
    order = F.struct(*(F.col(f"`{c}`") for c in order_by), F.xxhash64(*(F.col(f"`{c}`") for c in register.columns)))
    named = [c.alias(f"__r_{k}") for k, c in register_keys.items()] + [S.sorted_tokens(F.col(f"`{register_name}`").cast("string")).alias("__r_name")]
    r_keys = [f"__r_{k}" for k in register_keys] + ["__r_name"]
    # of register rows that would score the same, the first one stands for all
    names = register.select(*named, order.alias("order")).where(F.col("__r_name").isNotNull()).groupBy(*r_keys).agg(F.min("order").alias("__r_order")).withColumn("__r", S.prepared("__r_name"))
    wanted = keyed.select(*l_keys).where(F.col("__l_name").isNotNull()).distinct().withColumn("__l", S.prepared("__l_name"))
    l, r = F.col("__l"), F.col("__r")
    on = S.may_reach(l, r, threshold) if within is None else S.may_reach(l, r, threshold) & within
    shared = [k for k in left_keys if k in register_keys]
    pairs = pairs_in_blocks(wanted, names, [f"__l_{k}" for k in shared], [f"__r_{k}" for k in shared], on, "__l_name")
    scored = S.with_common(pairs, l, r, "__lcs").where(S.reaches(F.col("__lcs"), l, r, threshold))
    rank = F.struct((-S.similarity(F.col("__lcs"), l, r)).alias("score"), F.col("__r_order").alias("order"), *r_keys)
    best = scored.groupBy(*l_keys).agg(F.min(rank).alias("__best")).select(*l_keys, F.col("__best.score").alias("__score"), *(F.col(f"__best.{k}").alias(k) for k in r_keys))
    row = F.struct(*(F.col(f"`{c}`") for c in register.columns))
    rows = register.select(*named, F.struct(order.alias("order"), row.alias("row")).alias("first")).where(F.col("__r_name").isNotNull()).groupBy(*r_keys).agg(F.min("first").alias("__first"))
    return keyed, best, rows


def _finish(left: DataFrame, register: DataFrame, found: tuple[DataFrame, DataFrame, DataFrame], description: str, prefix: str, id_col: str | None, ordered: bool) -> Match:
    keyed, best, rows = found
    l_keys, r_keys = [c for c in best.columns if c.startswith("__l_")], [c for c in best.columns if c.startswith("__r_")]
    chosen = best.join(rows, r_keys).select(*l_keys, "__score", "__first")
    full = keyed.join(chosen, l_keys)
    out = [F.col(f"`{c}`") for c in left.columns]
    out += [F.col(f"__first.row.`{c}`").alias(prefix + c) for c in register.columns]
    out += [F.bround(-F.col("__score"), 2).alias(SCORE), F.lit(description).alias(MATCH_TYPE)]
    matched = full.select(*out)
    if ordered:
        matched = matched.orderBy(F.desc(SCORE))
    remaining = keyed.join(best.select(*l_keys), l_keys, "left_anti").select(*(F.col(f"`{c}`") for c in left.columns))
    # rows of one key share their register row, so keys with their numbers of left rows are enough
    times = keyed.join(best, l_keys).groupBy(*r_keys).agg(F.count(F.lit(1)).alias("matches")).where("matches > 1")
    reused = times.join(rows, r_keys).select("__first.row.*", "matches")
    return Match(matched, remaining, reused, id_col)


def fuzzy_match(left: DataFrame, register: DataFrame, left_filter_cols: list[str], register_filter_cols: list[str], left_name: str, register_name: str, description: str, threshold: float = 80, id_col: str | None = None, order_by: list[str] | None = None, prefix: str = PREFIX, ordered: bool = False) -> Match:
    """Inside blocks of equal filter columns, the register row with the most similar name, if it scores ``threshold`` or more.

    Null filters or names match nothing. ``ordered``: matched rows come by descending score, at the price of a global sort.
    """
    need_frame(left, "left")
    need_frame(register, "register")
    _check_pairs(left, register, left_filter_cols, register_filter_cols)
    need_columns(left, [left_name], "the left table")
    need_columns(register, [register_name, *([id_col] if id_col else []), *(order_by or [])], "the register")
    _suffix_warning(left, prefix)
    order = order_by or ([id_col] if id_col else [])
    lk = {f"f{i}": F.col(f"`{c}`") for i, c in enumerate(left_filter_cols)}
    rk = {f"f{i}": F.col(f"`{c}`") for i, c in enumerate(register_filter_cols)}
    found = _best(left, register, lk, rk, None, left_name, register_name, threshold, order)
    return _finish(left, register, found, description, prefix, id_col, ordered)


def tidy_school(c: Column) -> Column:
    """A school's name as it is compared: title case, white space collapsed."""
    return collapse(strip(title(c.cast("string"))))


def school_age_match(left: DataFrame, register: DataFrame, left_school: str, register_school: str, left_name: str, register_name: str, left_year_group: str, register_dob: str, description: str, id_col: str = ID_COLUMN, academic_year_start: int | None = None, threshold: float = 80, order_by: list[str] | None = None, prefix: str = PREFIX, ordered: bool = False) -> Match:
    """Fuzzy match between pupils of one school whose date of birth lies in the year group's range.

    Rows with a year group that can't be understood, or without a school, stay unmatched. Schools are compared tidied and
    returned as they were. ``ordered``: as in ``fuzzy_match``.
    """
    need_frame(left, "left")
    need_frame(register, "register")
    need_columns(left, [left_school, left_name, left_year_group], "the left table")
    need_columns(register, [register_name, register_school, register_dob, id_col, *(order_by or [])], "the register")
    dob = F.col(f"`{register_dob}`")
    if not isinstance(register.schema[register_dob].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if not isinstance(register.schema[register_dob].dataType, T.StringType):
            raise TypeError(f"{register_dob!r} is no date and can't be read as one")
        logger.warning("%r is read as a date", register_dob)
    ages = dob_range(F.col(f"`{left_year_group}`"), academic_year_start, "coerce")
    lk = {"school": tidy_school(F.col(f"`{left_school}`")), "from": ages["first"], "to": ages["last"]}
    rk = {"school": tidy_school(F.col(f"`{register_school}`")), "dob": F.to_date(dob)}
    within = F.col("__r_dob").between(F.col("__l_from"), F.col("__l_to"))
    order = order_by or [id_col]
    found = _best(left, register, lk, rk, within, left_name, register_name, threshold, order)
    return _finish(left, register, found, description, prefix, id_col, ordered)


def waterfall(*matches: Match) -> DataFrame:
    """Matched rows of several steps in one table; columns that a step lacks are null."""
    out = matches[0].matched
    for m in matches[1:]:
        out = out.unionByName(m.matched, allowMissingColumns=True)
    return out
