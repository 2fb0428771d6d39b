"""Indel similarity of short texts (``ratio`` and ``token_sort_ratio``) as Catalyst expressions.

The similarity is 100 * 2 * LCS / (|a| + |b|). The longest common subsequence comes from the bit-parallel recurrence
(Allison and Dix; Crochemore et al.; Hyyro) over one 64-bit word, and over several words with a carry where both texts have
more than 62 characters. Masks of a text's characters are made once for each text, before any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, _col

#: Bits of a word that the recurrence uses: the sum of two words and a carry stays below the sign bit.
WORD = 62


def sorted_tokens(c: Column | str) -> Column:
    """Words in code-point order, one space apart."""
    return F.array_join(F.array_sort(F.filter(F.split(_col(c), f"{SPACE}+"), lambda x: x != "")), " ")


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _ones(n: Column) -> Column:
    """A word with its lowest ``n`` bits set."""
    return F.call_function("shiftleft", _long(1), n.cast("int")) - _long(1)


def _mask(chars: Column, ch: Column) -> Column:
    """Where ``ch`` stands among up to 62 characters."""
    bits = F.transform(chars, lambda x, i: F.when(x == ch, F.call_function("shiftleft", _long(1), i)).otherwise(_long(0)))
    return F.aggregate(bits, _long(0), lambda s, x: s.bitwiseOR(x))


def prepared(c: Column | str) -> Column:
    """Struct (text, size, chars, masks, words) of a text: a mask for each character, or one for each 62 places of a long text."""
    c = _col(c)
    size = F.length(c)
    chars = F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    last = F.floor((size - 1) / WORD).cast("int")
    one = F.map_from_entries(F.transform(F.array_distinct(chars), lambda ch: F.struct(ch, _mask(chars, ch))))
    several = F.map_from_entries(F.transform(F.array_distinct(chars), lambda ch: F.struct(ch, F.transform(F.sequence(F.lit(0), last), lambda j: _mask(F.slice(chars, j * WORD + 1, WORD), ch)))))
    return F.struct(c.alias("text"), size.alias("size"), chars.alias("chars"), F.when(size <= WORD, one).alias("masks"), F.when(size > WORD, several).alias("words"))


def _lcs(a: Column, b: Column) -> Column:
    """Characters of the longest common subsequence; ``a`` has masks."""
    full = _ones(a["size"])

    def step(s: Column, ch: Column) -> Column:
        u = s.bitwiseAND(F.coalesce(F.try_element_at(a["masks"], ch), _long(0)))
        return (s + u).bitwiseOR(s - u).bitwiseAND(full)

    return a["size"] - F.bit_count(F.aggregate(b["chars"], full, step))


def _long_lcs(a: Column, b: Column) -> Column:
    """The same for a long ``a``: its state is an array of words, and sums carry from one to the next."""
    last = F.floor((a["size"] - 1) / WORD).cast("int")
    places = F.sequence(F.lit(0), last)
    full = F.transform(places, lambda j: _ones(F.least(F.lit(WORD), a["size"] - j * WORD)))

    def step(state: Column, ch: Column) -> Column:
        masks = F.try_element_at(a["words"], ch)

        def word(acc: Column, j: Column) -> Column:
            s = F.get(state, j)
            u = s.bitwiseAND(F.get(masks, j))
            total = s + u + acc["carry"]
            now = total.bitwiseAND(_long((1 << WORD) - 1)).bitwiseOR(s - u).bitwiseAND(F.get(full, j))
            return F.struct(F.concat(acc["words"], F.array(now)).alias("words"), F.shiftright(total, WORD).alias("carry"))

        start = F.struct(F.array().cast("array<bigint>").alias("words"), _long(0).alias("carry"))
        return F.when(masks.isNull(), state).otherwise(F.aggregate(places, start, word)["words"])

    left = F.aggregate(b["chars"], full, step)
    return a["size"] - F.aggregate(left, F.lit(0), lambda n, w: n + F.bit_count(w))


def common(a: Column, b: Column) -> Column:
    """LCS length of two prepared texts."""
    return F.when(a["masks"].isNotNull(), _lcs(a, b)).when(b["masks"].isNotNull(), _lcs(b, a)).when(a["words"].isNotNull() & b["words"].isNotNull(), _long_lcs(a, b))


def with_common(pairs: DataFrame, a: Column, b: Column, name: str) -> DataFrame:
    """``pairs`` with the LCS length of two prepared texts, computed once for each pair.

    A plain column would be copied into every filter and projection above it, and into the join below; a generator isn't.
    """
    return pairs.select("*", F.inline(F.array(F.struct(common(a, b).alias(name)))))


def reaches(lcs: Column, a: Column, b: Column, threshold: float) -> Column:
    """Whether the similarity is at least ``threshold``, without dividing."""
    return 200 * lcs >= F.lit(threshold) * (a["size"] + b["size"])


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """An upper bound from the lengths alone: a common subsequence is no longer than the shorter text."""
    return 200 * F.least(a["size"], b["size"]) >= F.lit(threshold) * (a["size"] + b["size"])


def similarity(lcs: Column, a: Column, b: Column) -> Column:
    """0 to 100; two empty texts are alike."""
    n = a["size"] + b["size"]
    return F.when(n == 0, F.lit(100.0)).otherwise(200.0 * lcs / n)


def ratio(a: Column | str, b: Column | str) -> Column:
    """Indel similarity of two columns, case and order as they are."""
    x, y = prepared(a), prepared(b)
    return similarity(common(x, y), x, y)


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    """Indel similarity of the sorted words of two columns."""
    return ratio(sorted_tokens(a), sorted_tokens(b))
