"""Main text of web pages by line-block distribution.

Markup is stripped so that each block of the page becomes a line, and a line weighs as many characters as it has,
those in links a quarter. Lines of paragraphs, headings and the like that aren't mostly links weigh STRUCTURE
more, loose text weighs half. The weights are summed over sliding windows of WINDOW lines. The text surges where a window
reaches SURGE, or half of the page's heaviest window if none does, and dives where a window falls below DIVE; lines
from the first to the last of such a stretch are the text, whatever they weigh. At
its ends, lines that are mostly links, copyright lines and, where most of the stretch isn't loose text, short loose lines are off again.

Windows run over the lines of one region. Menus, headers, footers, sidebars, forms and dialogs, by element or role, and
elements whose class or id consists of words for such parts weigh nothing and are no part of any region. An element whose
class or id only contains such a word (share-prices) is a region of its own, whose lines weigh a quarter. If the page marks an article, its
lines weigh STRUCTURE more each, links too, so that the surge is where it begins and the dive where it ends; lines outside weigh
nothing. A main element confines the regions in the same way, but adds no weight.

Character references are decoded as HTML5 says, white space inside a block becomes one
space, and blocks are joined by newlines. Reading a page takes time in proportion to its length, whatever its markup.

Cases: null and empty pages have an empty text, and so have pages of nothing but links. Unclosed elements end with the element around
them. A tag that the page's end cuts is no text; where a quote is never closed, the tag ends at the next >. Repeated rows and null page_ids
are kept. Very long pages are read as a whole. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlark.llm._shared import bound_batches

WINDOW = 3
SURGE = 40
DIVE = 4
STRUCTURE = 40
LINKED = 0.25  #: weight of a character in a link
LOOSE = 0.5  #: weight of a character of loose text
DOUBTFUL = 0.25  #: weight of a character in an element that may not belong to the text

# Elements by their part in a page.
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas select button textarea".split())
RAW = frozenset("script style textarea title".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
TEXTUAL = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
CLOSES_P = BLOCK - frozenset("option".split())
SIBLINGS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
KEEPS = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]), "option": frozenset(["select"])}
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
# Words for parts that aren't the main text, and words that say nothing of the kind beside them.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu modal nav navbar navigation newsletter notice notification pagination popup promo promoted promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
NEUTRAL_WORDS = frozenset("area bar block body bottom box button buttons col column container content footer form group header html icons inner inline item items js large left link links list main mobile page panel post posts right row section signup site slot small thread top unit user users wrap wrapper x xs".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PLAIN_END = re.compile(r"[^>\"']*>")
VALUE = re.compile(r"[^>=]*(?:=\s*)?")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")
LEGAL = re.compile(r"\s*(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)


class Line(NamedTuple):
    text: str
    plain: int  #: characters outside links
    region: tuple  #: article, main and doubtful element that it is in
    apart: bool
    element: str


def _doubt(attributes: str) -> int:
    """Do class, id or role say that the element isn't part of the main text? 2: yes, 1: perhaps."""
    out = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ASIDE_ROLES):
            return 2
        if name in ("class", "id"):
            for one in value.split():
                words = WORD.findall(one)
                if not ASIDE_WORDS.isdisjoint(words):
                    if all(w in ASIDE_WORDS or w in NEUTRAL_WORDS for w in words):
                        return 2
                    out = 1
    return out


def _tag_end(page: str, at: int) -> int:
    """The index of the > that ends the tag; -1 if the page ends before."""
    if m := PLAIN_END.match(page, at):
        return m.end() - 1
    while True:
        at = VALUE.match(page, at).end()
        if at >= len(page):
            return -1
        if page[at] == ">":
            return at
        if page[at] in "\"'":
            # a quote opens a value behind = only; elsewhere it's part of a name
            close = page.find(page[at], at + 1)
            if close < 0:
                return page.find(">", at)
            at = close + 1


class Reader:
    """Cuts a page into lines. Where elements are open is kept by name, so no tag looks through the whole stack."""

    def __init__(self):
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.plain: list[str] = []
        self.element = ""
        self.stack: list[tuple] = []  # name; unseen, apart, region around it
        self.open: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.unseen = self.apart = False
        self.region: tuple = (0, 0, 0)
        self.links = self.count = 0

    def flush(self):
        line = SPACE.sub(" ", "".join(self.text)).strip()
        if line:
            self.lines.append(Line(line, len(SPACE.sub(" ", "".join(self.plain)).strip()), self.region, self.apart, self.element))
        self.text.clear()
        self.plain.clear()
        self.element = ""

    def close(self, depth: int):
        while len(self.stack) > depth:
            name, unseen, apart, region = self.stack.pop()
            self.open[name].pop()
            if name in BLOCK:
                self.flush()
                self.blocks.pop()
            self.links -= name == "a"
            self.unseen, self.apart, self.region = unseen, apart, region

    def last(self, names) -> int:
        return max((self.open[n][-1] for n in names if self.open[n]), default=-1)

    def add(self, piece: str):
        if piece and not self.unseen:
            if "&" in piece:
                piece = html.unescape(piece)
            self.text.append(piece)
            if not self.links:
                self.plain.append(piece)
            if not self.element and self.blocks and not piece.isspace():
                self.element = self.stack[self.blocks[-1]][0]

    def end(self, name: str):
        if self.open[name]:
            self.close(self.open[name][-1])
        elif name in BLOCK:
            self.flush()

    def begin(self, name: str, attributes: str):
        if name in VOID:
            if name == "hr":
                self.flush()
            elif name == "br":
                self.add(" ")
            return
        if name in CLOSES_P and self.open["p"]:
            # formatting that the paragraph left open goes on in none of the next blocks
            p = self.open["p"][-1]
            if p >= (self.blocks[-1] if self.blocks else 0):
                self.close(p)
        if name in SIBLINGS:
            before = self.last(SIBLINGS[name])
            if before > self.last(KEEPS[name]):
                self.close(before)
        if name in BLOCK:
            self.flush()
        if attributes.endswith("/") and name not in BLOCK:
            return
        self.stack.append((name, self.unseen, self.apart, self.region))
        self.open[name].append(len(self.stack) - 1)
        if name in BLOCK:
            self.blocks.append(len(self.stack) - 1)
        self.links += name == "a"
        article, main, doubtful = self.region
        self.count += 1
        if name == "article":
            # reader comments and teasers are often articles of their own
            self.apart = self.apart or (bool(attributes) and _doubt(attributes) == 2)
            article = article or self.count
        elif name == "main":
            main = main or self.count
        elif name not in ("html", "body"):
            doubt = _doubt(attributes) if attributes else 0
            # a header inside an article belongs to it, unless it says otherwise
            self.apart = self.apart or doubt == 2 or (name in ASIDE and not (name == "header" and article))
            if doubt == 1:
                doubtful = self.count
        self.region = (article, main, doubtful)
        self.unseen = self.unseen or name in UNSEEN


def lines(page: str) -> list[Line]:
    """The lines of a page: one for each block with text."""
    r = Reader()
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            r.add(page[at:])
            break
        following = page[lt + 1 : lt + 2]
        if following in ("!", "?"):
            r.add(page[at:lt])
            if page.startswith("<!--", lt):
                end, width = page.find("-->", lt + 4), 3
            elif page.startswith("<![CDATA[", lt):
                end, width = page.find("]]>", lt), 3
            else:
                end, width = page.find(">", lt), 1
            at = size if end < 0 else end + width
            continue
        m = TAG.match(page, lt)
        if not m:
            r.add(page[at : lt + 1])
            at = lt + 1
            continue
        r.add(page[at:lt])
        gt = _tag_end(page, m.end())
        if gt < 0:
            break
        at = gt + 1
        name = m[2].lower()
        if m[1]:
            r.end(name)
            continue
        r.begin(name, page[m.end() : gt].strip())
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.start() if end else size
    r.close(0)
    r.flush()
    return r.lines


def weight(line: Line) -> float:
    """How much a line counts in its windows."""
    linked = len(line.text) - line.plain
    if line.region[0] and not line.region[2]:
        return STRUCTURE + line.plain + LINKED * linked
    textual = line.element in TEXTUAL
    out = (1.0 if textual else LOOSE) * (line.plain + LINKED * linked)
    if line.region[2]:
        return DOUBTFUL * out
    return out + STRUCTURE * (textual and 2 * line.plain >= len(line.text) and not LEGAL.match(line.text))


def stretches(weights: np.ndarray, surge: float) -> list[tuple[int, int]]:
    """First line and last line + 1 of each stretch from a surge to the dive behind it."""
    total = np.concatenate(([0.0], np.cumsum(weights)))
    n = len(weights)
    block = total[np.minimum(np.arange(n) + WINDOW, n)] - total[:n]
    out, i = [], 0
    while i < n:
        if block[i] < surge:
            i += 1
            continue
        # lines before the surge whose windows have not dived belong to it
        first = i
        while first > (out[-1][1] if out else 0) and block[first - 1] >= DIVE:
            first -= 1
        dive = i
        while dive < n and block[dive] >= DIVE:
            dive += 1
        out.append((first, dive))
        i = dive
    return out


def _trimmed(first: int, last: int, found: list[Line], weights: np.ndarray) -> tuple[int, int]:
    """The stretch without what only touches the text at its ends."""
    textual = np.array([x.element in TEXTUAL for x in found[first:last]])
    least = LOOSE * STRUCTURE if 2 * weights[first:last][textual].sum() >= weights[first:last].sum() else 0.0

    def off(k: int) -> bool:
        line = found[k]
        if line.region[0] and not line.region[2]:
            return False
        linked = 2 * line.plain < len(line.text)
        return weights[k] == 0 or linked or LEGAL.match(line.text) is not None or (line.element not in TEXTUAL and weights[k] < least)

    while first < last and off(first):
        first += 1
    while last > first and off(last - 1):
        last -= 1
    return first, last


def main_text(page: str | None) -> str:
    """The main text of a page."""
    found = [x for x in lines(page or "") if not x.apart]
    for mark in (0, 1):
        if any(x.region[mark] for x in found):
            found = [x for x in found if x.region[mark]]
            break
    regions: dict[tuple, list[int]] = {}
    for k, x in enumerate(found):
        regions.setdefault(x.region, []).append(k)
    weights = np.array([weight(x) for x in found])
    if not any(x.plain or x.region[0] for x in found):
        return ""
    heaviest = max(float(np.convolve(weights[at], np.ones(WINDOW)).max()) for at in regions.values())
    surge = SURGE if heaviest >= SURGE else heaviest / 2
    keep = np.zeros(len(found), bool)
    for at in regions.values():
        part, own = [found[k] for k in at], weights[at]
        for first, last in stretches(own, surge):
            first, last = _trimmed(first, last, part, own)
            keep[at[first:last]] = True
    return "\n".join(x.text for x, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    bound_batches(pages.sparkSession)
    schema = "page_id long, url string, text string, n_chars long"

    def work(stream):
        for batch in stream:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [main_text(p) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(work, schema)
