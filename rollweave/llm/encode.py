"""Exact, memoised byte-level BPE encoding of Arrow text columns.

The library's own ``encode`` spends most of its time on words that it has met before. Texts made of plain
characters are cut into the pre-tokenizer's words by Arrow kernels, every distinct word is encoded once by the
``tokenizers`` library, and a text's ids are the joined ids of its words. Other texts are cut only where the
pre-tokenizer always cuts: before a single space between two characters that aren't white space. Memory is
bounded: the memo is emptied when it is full, and a call should bring a few megabytes at a time.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that are \\p{L} in every Unicode version, and ASCII marks without the apostrophe (it starts contractions).
_L, _P = "A-Za-zÀ-ÖØ-öø-ʯ", r"!-&(-/:-@\[-`{-~"
#: A text that this finds has characters or white space that need more care.
_HARD = f"[^{_L}{_P}0-9 \n]|  | \n|\n\n| $"
#: In a text that this doesn't find either, commas, full stops and line feeds stand alone between words.
_MARKED = f"[^{_L}0-9 ,.\n]|[ \n,.][,.]|[{_L}][0-9]|[0-9][{_L}]"
_WORDS = f" ?[{_L}]+| ?[{_P}]+| ?[0-9]+|\n"
_SURE = re.compile(f" ?(?:[{_L}]+|[{_P}]+|[0-9]+)")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SPACE = re.compile(r"\s")
#: Never part of a text that _HARD passes.
_BAR = "\x01"
MEMO = 600_000


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
_SPACE_LETTER, _FEED_LETTER = chr(_BYTE_LETTERS[32]), chr(_BYTE_LETTERS[10])


def _spelt(word: str) -> str:
    """A word in the byte-level alphabet. Printable ASCII stands for itself, so most words only change a space in front."""
    if not word.isascii():
        return word.encode().decode("latin-1").translate(_BYTE_LETTERS)
    if word[:1] == " ":
        return _SPACE_LETTER + word[1:]
    return _FEED_LETTER if word == "\n" else word


class Encoder:
    """Encodes with the tokenizer file at ``path``, special tokens' strings taken as ordinary text.

    Words that were met are numbered: word k has pool[ends[k]:ends[k + 1]]. The memo is emptied between calls, never inside
    one, so it holds MEMO words and those of one call at most.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self._empty()

    def _empty(self) -> None:
        self.memo: dict[str, int] = {}
        self.pool, self.ends = array("I"), array("i", [0])

    def whole(self, text: str) -> list[int]:
        """Ids of a text by the library alone."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, word: str, sure: bool = False) -> int:
        """Number of a new word; ``sure``: the pre-tokenizer is known to leave it whole."""
        if sure or _SURE.fullmatch(word):
            self.pool.extend([t.id for t in self.model.tokenize(_spelt(word))])
        else:
            self.pool.extend(self.whole(word))
        self.ends.append(len(self.pool))
        number = self.memo[word] = len(self.memo)
        return number

    def _joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered words, one after the other, and how many ids there are up to each word."""
        if not (len(numbers) and self.pool):
            return np.zeros(0, "<u4"), np.zeros(len(numbers), np.int32)
        ends = np.frombuffer(self.ends, np.int32)
        stops = ends[1:][numbers]
        each = stops - ends[numbers]
        upto = np.cumsum(each, dtype=np.int32)
        stops -= upto
        at = np.repeat(stops, each)
        at += np.arange(upto[-1], dtype=np.int32)
        return np.frombuffer(self.pool, np.uint32)[at], upto

    def careful(self, text: str) -> np.ndarray:
        """Ids of a text of any characters."""
        get, learn = self.memo.get, self._learn
        out, known = [], []

        def flush() -> None:
            out.append(self._joined(np.array(known, np.int32))[0])
            known.clear()

        for p in _CUT.split(text) if text else []:
            if len(p) > 200 or _SPACE.search(p, 1):
                flush()
                out.append(np.array(self.whole(p), "<u4"))
            else:
                known.append(learn(p) if (k := get(p)) is None else k)
        flush()
        return np.concatenate(out)

    def _plain(self, texts: pa.Array, marked: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if marked:
            barred = pc.replace_substring_regex(texts, _WORDS, rf"\0{_BAR}")
        else:
            barred = texts
            for what, by in ((" ", f"{_BAR} "), (",", f"{_BAR},{_BAR}"), (".", f"{_BAR}.{_BAR}"), ("\n", f"{_BAR}\n{_BAR}")):
                barred = pc.replace_substring(barred, what, by)
        lists = pc.split_pattern(barred, _BAR)
        words = lists.flatten().dictionary_encode()
        get, learn = self.memo.get, self._learn
        known = [learn(w, True) if (k := get(w)) is None else k for w in words.dictionary.to_numpy(zero_copy_only=False)]
        ids, upto = self._joined(np.array(known, np.int32)[words.indices.to_numpy(zero_copy_only=False)])
        bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        return ids, np.diff(np.concatenate(([0], upto))[bounds])

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]], the id ``end`` last; null counts as empty."""
        if len(self.memo) > MEMO:
            self._empty()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        hard = np.asarray(pc.match_substring_regex(texts, _HARD))
        marked = np.asarray(pc.match_substring_regex(texts, _MARKED))
        parts, counts, order = [], np.zeros(len(texts), np.int64), []
        for chosen, kind in ((~hard & ~marked, False), (~hard & marked, True)):
            rows = np.flatnonzero(chosen)
            if len(rows):
                ids, counts[rows] = self._plain(texts.take(pa.array(rows)), kind)
                parts.append(ids)
                order.append(rows)
        rows = np.flatnonzero(hard)
        if len(rows):
            found = [self.careful(t) for t in texts.take(pa.array(rows)).to_pylist()]
            counts[rows] = [len(f) for f in found]
            parts.append(np.concatenate(found))
            order.append(rows)
        extra = int(end is not None)
        bounds = np.concatenate(([0], np.cumsum(counts + extra)))
        out = np.full(bounds[-1], end or 0, "<u4")
        for ids, rows in zip(parts, order):
            each = counts[rows]
            at = np.cumsum(each)
            out[np.arange(len(ids)) + np.repeat(bounds[rows] - at + each, each)] = ids
        return out, bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that its memo lives over tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
