"""Main text of web pages (operator 1).

The standard library's streaming parser turns a page into lines, one for each block of text, and counts the tags of
each.  A line's ratio of text to tags is high in running text and low in menus and link lists; on a log scale, as
one paragraph may be a thousand times as long as the next.  Lines inside page furniture have ratio 0: elements of
such a name (navigation, forms and so on), of such a role, or with a class or id that consists of such words alone
(``comment-list``, not ``social-effects``).  The ratios are smoothed with a Gaussian, and lines whose smoothed ratio
is at or above THRESHOLD of the mean ratio of the page's text (each character counts) form the content clusters.  So a short
paragraph between long ones is content and a lone short line among menus is not, wherever in the page they are.
A gap of up to REACH lines between two clusters of the same element belongs to them, and so does a heading right
before a cluster.  Furniture is left out of a
cluster; an inline element of that kind loses its own text only, not its line.

Defined results: a null or empty page has the empty text; broken markup is read as far as the parser can, and a tag
cut off by the end of the page is dropped; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored.  Pages are handled one at a time, whole, in time in proportion to their length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 2.0
THRESHOLD = 0.15
REACH = 6

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text.
SILENT = frozenset("script style noscript template title head svg iframe object canvas audio video".split())
#: Elements that hold page furniture.
FURNITURE = frozenset("nav footer aside form button select textarea dialog menu fieldset label".split())
#: Elements that begin a line.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot"
    " thead tr ul caption".split()
)
ROOTS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id or role that mark page furniture.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies"
    " consent disclaimer discussion disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice"
    " popup promo promotion related replies reply share sharing sidebar sidenav signup social sponsor sponsored subscribe"
    " toolbar widget complementary contentinfo search alert dialog login".split()
)
#: Words that say nothing beside those.
NEUTRAL = frozenset(
    "area articles bar bottom box btn button buttons block card col column container content form global group head holder icon"
    " icons inline inner item items left line link links list lower main outer page panel post posts primary right row section secondary"
    " site slot stories sub text the thread title top ul unit upper wrap wrapper js is has".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CUT_OFF = re.compile(r"<[a-zA-Z/!][^<>]*\Z")
_BAD_DECLARATION = re.compile(r"<!\[(?!CDATA\[)")


def marks(value: str) -> bool:
    """Whether a class, id or role consists of furniture words: some token has one, and nothing else but neutral words."""
    for token in value.lower().split():
        words = [w for w in _SPLIT.split(token) if w and not w.isdigit()]
        if not HINTS.isdisjoint(words) and all(w in HINTS or w in NEUTRAL for w in words):
            return True
    return False


class Lines(HTMLParser):
    """Parser events to lines: (text, tags, furniture, number of the block element around it, whether it is a heading)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # open elements: (tag, silent, furniture, number); where each tag is open, and where blocks other than p are
        self.open: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.hard: list[int] = [0]
        self.number = 0
        self.done: list[tuple[str, int, bool, int, bool]] = []
        self._begin()

    def _begin(self) -> None:
        self.parts: list[tuple[str, bool]] = []
        self.tags = 0
        self.where: tuple[bool, int, bool] | None = None

    def _text(self) -> str:
        """The line's text without that of inline furniture; if there is no other, all of it."""
        if all(furniture or text.isspace() for text, furniture in self.parts):
            return " ".join("".join(text for text, _ in self.parts).split())
        out, gap = [], False
        for text, furniture in self.parts:
            if not furniture:
                out.append(" " + text if gap and text[:1].isalnum() else text)
            gap = furniture
        return " ".join("".join(out).split())

    def end_line(self) -> None:
        text = self._text()
        if text:
            self.done.append((text, self.tags, *(self.where or (self.open[-1][2], 0, False))))
        elif self.done and self.tags:
            last = self.done[-1]
            self.done[-1] = (last[0], last[1] + self.tags, *last[2:])
        self._begin()

    def _push(self, tag: str, silent: bool, furniture: bool) -> None:
        self.number += 1
        i = len(self.open)
        self.open.append((tag, silent, furniture, self.number))
        self.at.setdefault(tag, []).append(i)
        if tag in BLOCK:
            self.blocks.append(i)
            if tag != "p":
                self.hard.append(i)

    def _cut(self, i: int) -> None:
        """Closes the open elements from the i-th on."""
        while len(self.open) > i:
            tag = self.open.pop()[0]
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
                if tag != "p":
                    self.hard.pop()

    def _close(self, tag: str) -> None:
        """An end tag: of an inline element it reaches no further than the block around it, of a paragraph than the next other block."""
        where = self.at.get(tag)
        if not where:
            return
        bound = self.hard[-1] if tag == "p" else self.blocks[-1] if self.blocks and tag not in BLOCK and tag not in SILENT else 0
        if where[-1] > bound:
            self._cut(where[-1])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK or tag in ("head", "title"):
            self.end_line()
            if tag in BLOCK and tag != "body":
                self._close("p")  # a paragraph ends where another block begins
            if tag == "body":
                self._close("head")
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append((" ", False))
            return
        if tag in ("td", "th"):
            self.parts.append((" ", False))
        top = self.open[-1]
        inside = any(self.at.get(r) for r in ROOTS)
        furniture = top[2] or tag in FURNITURE or (tag == "header" and not inside)
        if not furniture and tag not in ("html", "body", "article", "main"):
            furniture = any(value and name in ("class", "id", "role") and marks(value) for name, value in attrs)
        furniture = furniture or any(name == "hidden" for name, _ in attrs)
        self._push(tag, top[1] or tag in SILENT, furniture)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK or tag in ("head", "title"):
            self.end_line()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top[1]:
            return
        if not data.isspace() and (self.where is None or self.where[0] and not top[2]):
            tag = self.open[self.hard[-1]][0]
            around = self.hard[-2] if len(self.hard) > 1 and (tag == "li" or tag in HEADINGS) else self.hard[-1]
            self.where = (top[2], self.open[around][3], tag in HEADINGS)
        self.parts.append((data, top[2]))


def smoothed(x: list[float], sigma: float = SIGMA) -> list[float]:
    """x under a Gaussian of the given width; at the ends over the weights that are there."""
    reach = max(1, math.ceil(3 * sigma))
    weight = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(reach + 1)]
    out = []
    for i in range(len(x)):
        lo, hi = max(0, i - reach), min(len(x), i + reach + 1)
        w = [weight[abs(j - i)] for j in range(lo, hi)]
        out.append(sum(a * b for a, b in zip(w, x[lo:hi], strict=True)) / sum(w))
    return out


def parsed(html: str) -> list[tuple[str, int, bool, int, bool]]:
    p = Lines()
    p.feed(_CUT_OFF.sub("", _BAD_DECLARATION.sub("&lt;![", html)))
    p.close()
    p.end_line()
    return p.done


def selected(lines: list[tuple[str, int, bool, int, bool]]) -> list[bool]:
    """Which lines are in content clusters."""
    ratio = [0.0 if furniture else math.log1p(len(text) / max(1, tags)) for text, tags, furniture, *_ in lines]
    if not any(ratio):
        return [False] * len(lines)
    weight = [len(line[0]) if r else 0 for line, r in zip(lines, ratio, strict=True)]
    least = THRESHOLD * sum(r * w for r, w in zip(ratio, weight, strict=True)) / sum(weight)
    take = [s >= least for s in smoothed(ratio)]
    last = None
    for i, t in enumerate(take):
        if t:
            if last is not None and 1 < i - last <= REACH + 1 and lines[i][3] == lines[last][3]:
                take[last:i] = [True] * (i - last)
            last = i
    for i in range(len(lines) - 2, -1, -1):
        take[i] = take[i] or lines[i][4] and take[i + 1] and bool(ratio[i + 1])
    return [t and bool(r) for t, r in zip(take, ratio, strict=True)]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, joined by empty lines."""
    lines = parsed(html) if html else []
    return "\n\n".join(x[0] for x, t in zip(lines, selected(lines), strict=True) if t)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = [main_text(h.as_py()) for h in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    d = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return d.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
