"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element; what never is main text (scripts, styles, menus, headers, footers,
sidebars, notices, adverts, forms, reader comments, hidden elements) leaves one blank line for each element; nothing else
does. Class names and ids tell some of these; a name that tells it by one word among others (``share-price``) counts outside articles alone. The lengths of BLOCK successive lines are summed at every line. Where the sum surges the text begins, where it dives
to zero (BLOCK left-out elements in a row) it ends; short lines before a region belong to it back to the first blank one. Text between is kept whole, in page order. On pages that mark their article,
its edges are edges of regions too: no sum and no region reaches over them. Outside, text must surge by itself; inside,
a sum of SURGE isn't asked where the whole article has none, but dives count.

Edge cases: null or empty html, and pages of boilerplate alone, give an empty text; broken markup is read as far as it goes (an
unclosed comment, script or tag hides what follows, as in a browser); repeated rows are extracted each; null ids and
urls stay null; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, short_batches, store

BLOCK = 3
#: A sum of line lengths from which text begins.
SURGE = 80
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\s+|/|[^\s\"'>=/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|[\"'=])*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'>=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements of HTML, by what they mean here.
_RAW = frozenset("script style textarea noscript template iframe noframes noembed title xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("head nav footer aside form svg canvas button select datalist dialog menu object audio video math map".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search".split()
)
_CLOSED_BY = {"p": _BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class and id names of what isn't main text.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup login social share sharing sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments disqus replies reply related recommended popup modal overlay widget pagination pager toolbar masthead topbar skip".split()
)
_COMMENT = frozenset("comment comments disqus reply replies".split())
#: Words that say where or in what shape something stands, but not what it is.
_NEUTRAL = frozenset(
    "area article articles bar block blocks body bottom box btn button buttons center col column container content div element fixed float group head heading holder icon icons inline "
    "inner item items large layout left line link links list main message mobile module outer page pane panel placeholder post posts right rail region row section site slot small "
    "sticky stories story tab text title top unit wide wrap wrapper".split()
)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip() else {}


def _names(attrs: dict[str, str]) -> tuple[set[str], set[str]]:
    """(sure, likely): words of class names and the id that name what isn't main text.

    A name is sure if all its words are such words or neutral ones; it is likely if only its first or last word is one (share-price,
    related-work). Names that tell what an element has or lacks don't count.
    """
    sure, likely = set(), set()
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = [p for p in re.split(r"[-_:]+|\d+", name) if p]
        if parts and parts[0] not in ("has", "no", "with", "without", "is"):
            if all(p in _NAMES or p in _NEUTRAL or p == "header" for p in parts):
                sure.update(parts)
            else:
                likely |= {parts[0], parts[-1]}
    return sure, likely


class _Page:
    """Reads markup into lines: (text, article) with article 2 in an article, 1 in a main element, 0 elsewhere."""

    def __init__(self):
        self.lines: list[tuple[str, int]] = []
        self.text: list[str] = []
        self.stack: list[tuple[str, bool, int]] = []  # tag, whether its text is left out, article

    def line(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.lines.append((text, self.stack[-1][2] if self.stack else 0))

    def blank(self) -> None:
        """A left-out element counts as a line without text."""
        self.line()
        self.lines.append(("", self.stack[-1][2] if self.stack else 0))

    def words(self, text: str) -> None:
        if not (self.stack and self.stack[-1][1]):
            self.text.append(html.unescape(text))

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        while self.stack and tag in _CLOSED_BY.get(self.stack[-1][0], ()):
            self.close(len(self.stack) - 1)
        if tag in _BLOCKS:
            self.line()
        elif tag == "br":
            self.words(" ")
        if tag in _VOID:
            return
        _, out, article = self.stack[-1] if self.stack else ("", False, 0)
        names, likely = _names(attrs)
        if not out and tag not in ("html", "body"):
            out = tag in _NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _ROLES
            out = out or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")) is not None
            out = out or bool(names & (_COMMENT if tag in ("article", "main") else _NAMES))
            # a likely name counts outside an article alone; inside, the density of the text decides
            out = out or not article and (tag == "header" or tag not in ("article", "main") and bool("header" in names | likely or likely & _NAMES))
            if out:
                self.blank()
        elif tag in ("article", "main") and not names & _COMMENT and self.form():
            out = False  # some sites wrap the whole page in a form
        if tag in ("article", "main") and not out:
            article = max(article, 2 if tag == "article" else 1)
        self.stack.append((tag, out, article))

    def form(self) -> bool:
        """Whether a form is what the text is left out for."""
        first = next((i for i, e in enumerate(self.stack) if e[1]), None)
        return first is not None and self.stack[first][0] == "form"

    def close(self, at: int) -> None:
        for tag, out, _ in reversed(self.stack[at:]):
            if tag in _BLOCKS or out:
                self.line()
        del self.stack[at:]

    def end(self, tag: str) -> None:
        if tag == "br" or tag == "p" and all(e[0] != "p" for e in self.stack):
            self.words(" ")
            return
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is None:
            return
        if tag not in _BLOCKS and any(e[0] in _BLOCKS for e in self.stack[at + 1 :]):
            del self.stack[at]  # an inline element that was closed too late
        else:
            self.close(at)


def lines_of(source: str) -> list[tuple[str, int]]:
    """Lines of a page, one for each block of text; each left-out element is one blank line."""
    page, at = _Page(), 0
    while at < len(source):
        open_ = source.find("<", at)
        if open_ < 0:
            break
        m = _TOKEN.match(source, open_)
        if not m:
            page.words(source[at : open_ + 1])
            at = open_ + 1
            continue
        page.words(source[at:open_])
        at = m.end()
        if m["cdata"]:
            page.words(m["cdata"])
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            page.end(tag)
        elif tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            at = source.find(">", close.start()) + 1 or len(source) if close else len(source)
        else:
            page.start(tag, _attributes(m["attrs"]))
    page.words(source[at:])
    page.line()
    return page.lines


def regions(lengths: list[int], block: int = BLOCK, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first, last + 1) of text between surge and dive points of the sums of ``block`` line lengths."""
    sums = [sum(lengths[i : i + block]) for i in range(len(lengths))]
    out, i = [], 0
    if sums and max(sums) < surge:
        surge = max(1, max(sums))  # a page of short lines: its densest place
    while i < len(sums):
        if sums[i] < surge:
            i += 1
            continue
        first = last = i
        while last < len(sums) and sums[last] > 0:
            last += 1
        while first > (out[-1][1] if out else 0) and lengths[first - 1]:
            first -= 1
        while last < len(lengths) and lengths[last]:
            last += 1
        out.append((first, last))
        i = last + 1
    return out


def main_text(source: str | None, block: int = BLOCK, surge: int = SURGE) -> str:
    """The main text of one page, blocks joined by a line feed."""
    lines = lines_of(source or "")
    best = max((a for t, a in lines if t), default=0)
    kept: list[str] = []
    for marked, run in groupby(lines, key=lambda line: line[1] >= best):
        texts = [t for t, _ in run]
        lengths = list(map(len, texts))
        # only a marked article, or a page without one, may be short of SURGE
        if marked or max(sum(lengths[i : i + block]) for i in range(len(lengths))) >= surge:
            kept += (t for first, last in regions(lengths, block, surge) for t in texts[first:last] if t)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html); a stored table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = [main_text(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    with short_batches(pages.sparkSession):
        return store(rows.mapInArrow(run, "page_id long, url string, text string, n_chars long"), "main-texts")
