"""Cleaning of names and other short texts: ``Column -> Column``, all inside the JVM unless said otherwise.

Null gives null in every mode. ``errors`` is checked for its spelling and decides what to do with values that can't be
strings; in a typed column there are none, so the modes differ only where a docstring says so.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import need_mode
from ..plans.session import find_package

#: All that counts as white space in a Unicode string.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
# Fixed value: the marks that remove_punctuation turns into spaces (hyphens and apostrophes stay).
PUNCTUATION = '!@#£$%^&*()_=+`~,.<>/?;:"\\|[]'


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(_col(c), f"{SPACE}+", " ")


def title(c: Column | str) -> Column:
    """Title case by runs of cased letters: any letter after a mark, a digit or a space is a capital."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"

    def one(run: Column) -> Column:
        first = F.upper(F.substring(run, 1, 1))  # may be two letters
        return F.concat(F.substring(first, 1, 1), F.lower(F.substring(first, 2, 9)), F.lower(F.substring(run, 2, 1 << 30)))

    return F.array_join(F.transform(F.regexp_extract_all(_col(c), F.lit(f"[{cased}]+|[^{cased}]+"), F.lit(0)), one), "")


def _change_after(c: Column, cut: str, change) -> Column:
    """Change the first letter of every piece but the first, pieces being cut at a zero-width pattern."""
    pieces = F.split(c, cut, -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i > 0, F.concat(change(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))).otherwise(p)), "")


def format_name(c: Column | str, errors: str = "raise") -> Column:
    """A name in title case without stray spaces; McDonald, O'Brien and Jane's keep their capitals as written here."""
    need_mode(errors)
    out = collapse(F.regexp_replace(title(strip(c)), f"{SPACE}*-{SPACE}*", "-"))
    # a lone capital that ends a word after an apostrophe is a suffix, but not after the O of Irish names
    out = F.when(out.contains("'"), _change_after(out, r"(?U)(?<=(?<!\bO)')(?=[A-Z]\b)", F.lower)).otherwise(out)
    return F.when(out.contains("Mc"), _change_after(out, r"(?U)(?<=\bMc)(?=[a-z])", F.upper)).otherwise(out)


def find_numbers(c: Column | str, errors: str = "raise", convert_to_string: bool = False) -> Column:
    """Whether there is an ASCII digit. ``convert_to_string``: any type, and null is a text without digits."""
    need_mode(errors)
    if convert_to_string:
        return F.coalesce(_col(c).cast("string").rlike("[0-9]"), F.lit(False))
    return _col(c).rlike("[0-9]")


def remove_numbers(c: Column | str, errors: str = "raise", convert_to_string: bool = False) -> Column:
    """Without ASCII digits, then stripped; texts without digits stay as they are."""
    need_mode(errors)
    c = _col(c).cast("string") if convert_to_string else _col(c)
    return F.when(c.rlike("[0-9]"), strip(F.regexp_replace(c, "[0-9]+", ""))).otherwise(c)


def full_name(first: Column | str, last: Column | str, middle: Column | str | None = None) -> Column:
    """First, middle and last names joined; null, blank and the text ``nan`` count as missing, nothing at all gives null."""
    parts = [strip(p) for p in (first, middle, last) if p is not None]
    parts = [F.when(F.lower(p) == "nan", F.lit("")).otherwise(p) for p in parts]
    return F.nullif(strip(collapse(F.concat_ws(" ", *parts))), F.lit(""))


@cache
def _decompositions() -> tuple[str, str, str, tuple[int, ...]]:
    """(from, to, dropped, code points of several): what every character becomes by NFKD without combining marks, Hangul aside."""
    one, to, drop, longer = [], [], [], []
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        out = "".join(x for x in unicodedata.normalize("NFKD", ch) if unicodedata.category(x) != "Mn")
        if out == ch:
            continue
        if len(out) == 1:
            one.append(ch)
            to.append(out)
        elif not out:
            drop.append(ch)
        else:
            longer.append(cp)
    return "".join(one), "".join(to), "".join(drop), tuple(longer)


def _ranges(points: list[int]) -> str:
    """Code points as the ranges of a regular expression's class; Hangul syllables are given by their ends."""
    points, out = sorted(points), []
    for p in points:
        if out and (p == out[-1][1] + 1 or p == 0xD7A3):
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if unicodedata.category(x) != "Mn"))


def remove_diacritics(c: Column | str, errors: str = "raise", exact: bool = True) -> Column:
    """Compatibility decomposition without combining marks.

    One translation table covers every character that becomes one or none. Characters that become several (and Hangul
    syllables) are left to an Arrow function, which gets only the texts that have any; ``exact=False`` leaves those
    characters alone and the plan without Python.
    """
    need_mode(errors)
    c = _col(c)
    one, to, drop, longer = _decompositions()
    plain = F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(c, one + drop, to)).otherwise(c)
    if not exact:
        return plain
    find_package()
    hard = c.rlike(r"[¼-¾\x{132}-\x{10ffff}]") & c.rlike(f"[{_ranges([0xAC00, 0xD7A3, *longer])}]")
    return F.when(hard, F.pandas_udf(_nfkd, "string")(F.when(hard, c))).otherwise(plain)


def remove_punctuation(c: Column | str, punctuation: str = PUNCTUATION, errors: str = "raise") -> Column:
    """Each listed mark becomes a space; then white space is collapsed and stripped."""
    need_mode(errors)
    return strip(collapse(F.translate(strip(c), punctuation, " " * len(punctuation))))
