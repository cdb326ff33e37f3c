"""Main text of HTML pages from flat text blocks.

A page is cut at block-level tags into flat text blocks. Each block has its word count and link density, those of its two
neighbours on each side, and context: whether an element of page furniture, or one named like it, encloses it, whether the page marks its article and the
block is outside. A decision tree (Gini, at least LEAST labelled blocks a leaf, trained here on the labelled table below) tells text from boilerplate. Names
count as whole words and only as context: the table holds blocks of text under each of them.

Defined results: null and empty html give an empty text; broken markup is read as browsers do where that matters for blocks (unclosed
elements end with their parents, an unclosed comment, script or style runs to the end, elements nested deeper than DEPTH count as their parent); a page without a
block of text gives an empty text; rows that repeat are extracted each; other columns pass through (text and n_chars are replaced, whatever
their case); an empty table gives no rows. The time for a page grows with its length, however broken it is.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm.common import bounded_batches, small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+(?=>)|[^>]*)>", re.S)
CUT_OFF = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
HIDDEN = {"script", "style", "template", "noscript", "textarea", "svg", "iframe", "object", "select", "canvas", "math", "title", "button"}
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in HIDDEN}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "head", "address"}
BODY = {"article", "main"}
SPACE = re.compile(r"[\s\x00]+")
NAMED = re.compile(r"(?:class|id|role|itemprop|aria-label|data-[\w-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Words of class, id and role names (cut at non-letters and at capitals) that are given to what surrounds a page's text, and to readers' comments.
NOTICE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr imprint legal login"
    " masthead menu modal nav navbar navigation newsletter notice overlay pager pagination paywall popup privacy promo promotion recommended related share sharing"
    " sidebar signin signup social sponsor sponsored subscribe subscription toast toc toolbar topbar trending widget".split()
)
READER_WORDS = {"comment", "commentlist", "comments", "disqus", "discussion", "feedback", "replies", "reply", "respond", "response", "responses"}
#: Of the text itself: with one of these, a header is not the site's.
TEXT_WORDS = {"article", "content", "entry", "main", "post", "story", "text"}
HIDDEN_BY = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD_CUT = re.compile(r"[a-z]+|[A-Z][a-z]*")
DEPTH = 512
LEAST = 5


class Block:
    """A run of text between block-level tags."""

    __slots__ = ("text", "words", "link_words", "chrome", "notice", "reader", "body", "tag")

    def __init__(self, text: str, words: int, link_words: int, chrome: bool, notice: bool, reader: bool, body: bool, tag: str) -> None:
        self.text, self.words, self.link_words, self.chrome, self.notice, self.reader, self.body, self.tag = text, words, link_words, chrome, notice, reader, body, tag


def names_of(attributes: str) -> tuple[bool, bool]:
    """Whether an element's names speak of page furniture (or it is hidden), and of readers' comments."""
    words = {x.lower() for value in NAMED.findall(attributes) for x in WORD_CUT.findall(value)}
    header = "header" in words and words.isdisjoint(TEXT_WORDS)
    return header or not words.isdisjoint(NOTICE_WORDS) or bool(HIDDEN_BY.search(attributes)), not words.isdisjoint(READER_WORDS)


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order, with character references decoded and white space as single spaces."""
    out: list[Block] = []
    open_tags: list[tuple[str, bool, bool, bool, bool]] = []  # name, chrome, notice, reader, body: each with what it inherits
    ends: dict[str, int | None] = {}  # where an element of hidden text that was searched for ends, None for nowhere
    parts: list[str] = []
    linked: list[str] = []
    opened: Counter[str] = Counter()

    def close(i: int) -> None:
        """Close the open elements from the i-th on."""
        opened.subtract(x[0] for x in open_tags[i:])
        del open_tags[i:]

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            _, *flags = open_tags[-1] if open_tags else ("", False, False, False, False)
            tag = next((x[0] for x in reversed(open_tags) if x[0] in BLOCKS), "")
            n = text.count(" ") + 1
            out.append(Block(text, n, min(n, len(entities.unescape(" ".join(linked)).split())), *flags, tag))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if opened["a"]:
            linked.append(text)

    page, at = page or "", 0
    last = page.rfind(">") + 1  # no tag ends after it
    while found := TOKEN.search(page, at, last):
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            if found[0].startswith("<!--") and not found[0].endswith("-->"):
                at = len(page)
                break
            continue
        if not found[1]:
            if name in HIDDEN:
                if not found[3].endswith("/"):
                    if ends.get(name, 0) is not None:
                        end = RAW[name].search(page, at)
                        ends[name] = end.end() if end else None
                    at = ends[name] or (at if name == "button" else len(page))
                parts.append(" ")
                continue
            if name in BLOCKS:
                flush()
                if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                    closes = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}[name]
                    for i in range(len(open_tags) - 1, -1, -1):
                        if open_tags[i][0] in closes:
                            close(i)
                        elif open_tags[i][0] in BLOCKS:
                            break
                elif opened["p"]:
                    i = next(i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] in BLOCKS)
                    if open_tags[i][0] == "p":
                        close(i)
            elif name == "br":
                parts.append(" ")
            elif name == "a" and opened["a"]:
                close(next(i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == "a"))
            if name not in VOID and not found[3].endswith("/") and len(open_tags) < DEPTH:
                _, chrome, notice, reader, body = open_tags[-1] if open_tags else ("", False, False, False, False)
                named = names_of(found[3]) if found[3] and name not in ("html", "body", "article", "main") else (False, False)
                open_tags.append((name, chrome or name in CHROME and not (body and name == "header"), notice or named[0], reader or named[1], body or name in BODY))
                opened[name] += 1
        else:
            if name in BLOCKS:
                flush()
            for i in range(len(open_tags) - 1, -1, -1) if opened[name] else ():
                if open_tags[i][0] == name:
                    close(i)
                    break
                if name not in BLOCKS and open_tags[i][0] in BLOCKS:
                    break
    add(CUT_OFF.sub("", page[at:]))
    flush()
    return out


FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after", "words_before_2", "density_before_2", "words_after_2", "density_after_2",
    "chrome", "notice", "reader", "in_body", "outside", "heading", "item",
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ITEMS = {"li", "td", "th", "dd", "dt"}


def features(page: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block of a page; a neighbour that is not there has no words and no links."""
    n = len(page)
    words = np.array([x.words for x in page], float)
    density = np.array([x.link_words / x.words for x in page], float)
    padded = [np.concatenate([np.zeros(2), x, np.zeros(2)]) for x in (words, density)]
    around = [x[2 + k : 2 + k + n] for k in (-1, 1, -2, 2) for x in padded]
    flags = np.array([(x.chrome, x.notice, x.reader, x.body, not x.body, x.tag in HEADINGS, x.tag in ITEMS) for x in page], float).reshape(n, 7)
    flags[:, 4] *= float(any(x.body for x in page))
    return np.column_stack([words, density, *around, flags])


#: Labelled pages, one a line: blocks as context, + for text or - for boilerplate, words and, after a stroke, how many of them are linked.
#: Contexts: a in the page's article, c in an element of page furniture (header, nav, footer, aside, form), n named like it, r named as readers' comments, h heading, i item of a list or table.
LABELLED = """
ci-1/1 ci-1/1 ci-2/2 n-13 ah+7 a+21 a+2 a+24/1 a+1 c-7
c-3/3 n-24 ah+8 a+31 ai+3 ai+15 a+11 an-12/2 ar-19 ar-30 c-17 c-6/5
ci-1/1 ci-1/1 ci-1/1 h+7 +30 +26 +33 c-14 n-20 n-13
c-6/6 n-15 ah+5 a+24 a+5 ai+7 ai+1 a+18 a+40 ac-14 ac-4 ac-4/4 r-17 n-12 c-8/1
-8/8 -9/9 +27 +4 +30 -2/2
-24 -17 ah+6 a+12/9 a+3/3 a+17/4 a+1 ai+5/1 ah+3 a+26 ai-8/8 ai-9/9 -25 -5
-2/2 -3/3 -2/2 ah+3 a+22 ai+1 ai+2 a+4/2 a+5 a+25 -23 -8
+32 +6 +31 +2 +29 r-19 -1
-41 ah+4 a+24 a+2 a+27 -46
ah+1 a+10 a+4 a+1
a+3
c-1/1 ah+4 a+9/9 a+26 a+3/3 a+16/14 a+4 ai-3/3 ai-16/16 ai-4/4
+16
+24 +5 +22
h+5 +20 +35 +3 +41 +18
-1/1 -1/1 -1/1 -1/1 h+9 +45 +12 +60 +3 +38 -1/1 -2/2 -9
-2/2 -2/2 -3/3 +52 +44 +1 +39 +25 -4/4 -3/3 -5/5 -10/2
-1/1 -2/2 -1/1 -6 +34 +28 +31 -2/2 -7/4 -3/3
-5/5 -4/4 -6 -3/3 h+6 +55 +2 +47 +30 -6/6 -5 -7/7
i-1/1 i-1/1 i-2/2 h+4 +29 i+6 i+9 i+4 +33 i-3/3 i-2/2
i-2/2 i-2/2 i-1/1 h+6 +42 i+12 i+3/1 i+15/2 +27 -3/3 -4
h-2 i-5/5 i-7/7 i-6/6 h+8 +36 +48 +5 +40 h-2 i-8/8 i-6/6 i-7/7
h-3 -9/9 -12/11 -8/8 h+5 +62 +20/3 +37 h-2 -7/7 -10/10
-4 -2/2 -3/3 -2/2 +38 +26/2 +44 +2 -3/2 -2/2 -12/8
ci-1/1 ci-1/1 n-9 ah+12 a+48 a+2 a+1 a+33 a+61 c-11
ci-1/1 ci-1/1 ci-1/1 n-8 ah+7 a+1 a+37 a+1 a+3 c-9
ci-1/1 ci-1/1 ci-1/1 ci-1/1 n-10 ah+4 a+1 c-8
ci-1/1 ci-1/1 n-11 ah+6 a+2 a+3 a+2 c-12
n-7 ah+3 a+90 a+120 a+15 c-6
c-12 ah+9 a+58 an+46 a+39 an+33 a+28 an-5 c-9
ah+6 a+33 an+52 an+41 a+30 an-9/9 an-3/3 an-4/4
h+7 +40 n+38 n+44 +29 n-6 n-4/4 n-8
h+5 +51 n+60 +34 n-10 r-25 r-12 r-48
ah+7 a+44 a+38 a+20 ar-31 ar-5 ar-44 ar-3/3 ar-27
ah+5 a+25 a+31 ar-2 ar-18 ar-60 ar-1/1 ar-22 c-4
ah+5 a+29 a+36 an-2 an-1/1 an-1/1 an-2/2 a+41 a+17 an-7 an-11/11
ah+8 a+47 ac-20 a+52 ac-31 a+9 ac-3/3 ac-6
c-5 c-30 ah+6 a+34 a+3 a+29 c-41 c-22/6 c-3/3
-14 -9 ah+7 a+39 a+4 a+51 -12 -30 -7
-3 -35 ah+9 a+18 a+43 ah+2 a+1 a+36 -28/4 -6/6
-50 ah+5 a+61 a+7 a+24 -33 -19
ah+4 a+30/24 a+41 a+5/5 a+22/9 a+3 -5/5 -2
ah+6 ai+4/4 ai+9/5 a+35 ai+2/1 ai+11 a+28 ai-4/4 ai-6/6 ai-5/5
ah+5 a+33 ai-2/2 ai-3/3 ai-7/7 ai-5/5
ah+6 a+8/8 a+33 a+7/7 a+25 a+12/12 a+40 ai-3/3
ah+5 a+27 a+3 a+19 a+2
ah+7 a+18 a+18 a+3
ah+3 a+36 a+22 a+44 a+1
h+6 +31 +19 +44 +2
h+4 +27 +36 +3 c-7
ah+5 a+27 a+31 a+6
ah+2 a+1
a+6 a+5 a+8
a+12
a+40 a+4
ah+4 a+17 a+9 a+22 a+5 a+2
ah+9 a+3 a+2 a+4 a+1 a+5
-2/2 -3/3 h+5 +24 +19
h+3 +14 +13
h+6 +36 +42 +15
+18 +21 +12
+44 +13 +28 +17
-3/3 h+4 +33 +24 +47 +21
+9 +26 +14 +30
+4 +22 +6 +41 +25
h+5 +5 +30 +11 +7 +26 +16
-3/3 -2/2 h+4 +26 +9 +11 +33 +20 -4 -6/6
ah+5 a+5/5 a+31 a+1/1 a+20
ah+6 a+3/3 a+2/2 a+26 a+19
ah+4 a+25 a+6/6 a+2 a+37
ah+4 a+7/7 a+12
a+6/6 a+3
ah+3 a+30 a+5/5 a+16
a+2 a+8/8
ah+3 a+1 a+5/5 a+1
ah+2 a+9/9 a+4 a+10/10 a+2
a+3 a+11/11 a+1 a+6/6 a+7
"""


def labelled_features() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of LABELLED."""
    rows, labels = [], []
    for line in LABELLED.split("\n")[1:-1]:
        page = []
        for where, sign, words, _, linked in (re.fullmatch(r"([a-z]*)([+-])(\d+)(/(\d+))?", x).groups() for x in line.split()):
            tag = "h2" if "h" in where else "li" if "i" in where else "p"
            page.append(Block("", int(words), int(linked or 0), "c" in where, "n" in where, "r" in where, "a" in where, tag))
            labels.append(int(sign == "+"))
        rows.append(features(page))
    return np.concatenate(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int) -> tuple:
    """A decision tree by Gini impurity: (share of ones,) or (feature, cut, below, above)."""
    share = float(y.mean())
    best = (2 * share * (1 - share) * len(y) - 1e-9, None)
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                below = x[:, f] <= cut
                if min(below.sum(), (~below).sum()) < least:
                    continue
                p, q = y[below].mean(), y[~below].mean()
                cost = 2 * p * (1 - p) * below.sum() + 2 * q * (1 - q) * (~below).sum()
                if cost < best[0]:
                    best = (cost, (f, float(cut)))
    if best[1] is None:
        return (share,)
    f, cut = best[1]
    below = x[:, f] <= cut
    return f, cut, grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)


def judged(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The leaf's share of ones for each row."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    f, cut, low, high = tree
    below = x[:, f] <= cut
    out = np.empty(len(x))
    out[below], out[~below] = judged(low, x[below]), judged(high, x[~below])
    return out


@cache
def trained(depth: int = 8, least: int = LEAST) -> tuple:
    return grow(*labelled_features(), depth, least)


def main_text(page: str | None) -> str:
    """The page's text blocks that the tree takes for text, one a line."""
    found = blocks(page)
    if not found:
        return ""
    keep = judged(trained(), features(found)) > 0.5
    return "\n".join(x.text for x, k in zip(found, keep, strict=True) if k)


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without their html, with text and n_chars."""
    rest = [f for f in pages.schema if f.name.lower() not in (column.lower(), "text", "n_chars")]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column, 4 << 20):
            texts = [main_text(x) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*(f.name for f in rest), "text", "n_chars"])

    return bounded_batches(pages.select(column, *(f.name for f in rest))).mapInArrow(run, f"{kinds}text string, n_chars long")
