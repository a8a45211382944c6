"""Main text of HTML pages by two passes of block rules.

A page is read once from left to right and cut into blocks at block-level tags; each
block knows its words, the share of them inside links, its tag, the elements around it
and what the markup says of them (a menu, a footer, an advert, reader comments).

Pass 1 scores each block on its own: length, stop-word density and link density, with the
markup as one more feature. Long text with a fair share of stop words is good, link lists
and long text without stop words are bad, short blocks and headings stay open unless their
place decides. Where the stop-word list does not cover a page (hardly one of its words in
all its longer blocks), density abstains and length decides; characters of scripts without
spaces count threefold. Pass 2 gives every open block the label of the nearest decided
neighbours: both alike, that label; unlike, the nearer one, and on a tie the one before,
but for a heading the one after. With no decided neighbour on one side the other side
holds; with none at all an open block is good if it is no heading, since a page of short
lines is still a page.

Names of classes are a hint, not a verdict. A word in a name counts unless a word of layout
stands before it (``no-sidebar``, ``has-comments``). An element so named, a form or a header
loses its text only if it does not hold the page's articles and not nearly all its good text:
a page wrapped in ``<div class="widget">`` or in one form is still a page. Menus, footers,
asides and hidden elements are always left out.

Defined results: null or empty html gives an empty text; character references are
decoded; white space inside a block becomes one space and blocks join by a blank line;
unclosed, misnested and cut-off markup is read as far as it goes (an open element ends
with its parent, a new block ends an open paragraph), in time linear in the page; nothing
is capped. An empty table gives no rows; other columns pass through, ``text`` and
``n_chars`` are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_arrow

# Element names of HTML, and words that pages use to name their parts.
SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas select option textarea button audio video map datalist".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot
th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset("nav footer aside".split())
DOUBTFUL = frozenset("form menu dialog search".split())
#: Words before a part's name that speak of the layout, not of the element.
LAYOUT = frozenset("no has have with without left right one two both main show hide enable disable is".split())
ARTICLE = frozenset("article main".split())
ARTICLE_NAMES = frozenset("article content post entry story main body text".split())
BAD_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment
comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav
navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommended related
replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe toc toolbar
tracking warning widget widgets""".split())
BAD_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
STOP_WORDS = frozenset("""the of and to in a is that for it was on are as with be this by from at or an not have which but they
der die das und ist den von zu mit sich des auf für als auch dem nicht ein eine im es wie er
le la les et des en un une du que est pour dans qui par sur pas plus au avec ce
el los las y de que es se por con para una su del lo como más al""".split())

LONG, SHORT, LINKS, STOPS, SOME_STOPS, COVERED, MOST = 140, 60, 0.35, 0.20, 0.10, 0.05, 0.8
#: Scripts written without spaces: kana, CJK ideographs, Thai, Lao, Khmer, Burmese.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>)|[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
GOOD, BAD, DOUBT, OPEN = "good", "bad", "doubt", "open"


def _names(value: str) -> set[str]:
    """The words of a class or id, without those that a word of layout qualifies."""
    out = set()
    for token in value.split():
        words = [x.lower() for x in _NAME.findall(token)]
        out.update(w for i, w in enumerate(words) if not i or words[i - 1] not in LAYOUT)
    return out


def _kind(tag: str, attrs: str, in_article: bool) -> str | None:
    """What an element's markup says: boilerplate, article, boilerplate by its name or
    tag alone (doubt), or nothing."""
    if tag in BOILERPLATE:
        return BAD
    doubt = tag in DOUBTFUL or tag == "header" and not in_article
    if attrs and tag not in ("html", "body"):
        found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
        if found.get("role", "").lower() in BAD_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
            return BAD
        names = _names(found.get("class", "")) | _names(found.get("id", ""))
        if in_article:
            names.discard("header")  # the article's own
        if names & BAD_NAMES and not (tag in ARTICLE and names & ARTICLE_NAMES):
            return DOUBT
        if found.get("role", "").lower() in ("article", "main") or found.get("itemprop", "").lower() == "articlebody":
            return GOOD
    return DOUBT if doubt else GOOD if tag in ARTICLE else None


class Block:
    __slots__ = ("tag", "kind", "doubt", "parts", "linked")

    def __init__(self, tag: str, kind: str | None, doubt: int):
        self.tag, self.kind, self.doubt, self.parts, self.linked = tag, kind, doubt, [], 0


class Page:
    """A page's blocks, (text, tag, kind, link density, innermost doubtful element) each,
    and its doubtful elements: what is around each (-1: none), whether an article is, and
    how many of the page's articles it holds (not counting those of doubtful ones inside)."""

    def __init__(self, page: str):
        self.blocks: list[tuple[str, str, str | None, float, int]] = []
        self.around: list[int] = []
        self.in_article: list[bool] = []
        self.holds: list[int] = []
        self.articles = 0
        self._stack: list[tuple[str, str | None, int]] = []  # open elements, what holds inside them
        self._places: dict[str, list[int]] = {}  # positions in the stack by name
        self._open_blocks: list[int] = []
        self._links = self._skip = 0
        self._block = Block("body", None, -1)
        self._read(page)

    def _flush(self, tag: str) -> None:
        block = self._block
        text = " ".join(entities.unescape("".join(block.parts)).split())
        if text:
            self.blocks.append((text, block.tag, block.kind, min(1.0, block.linked / len(text)), block.doubt))
        _, kind, doubt = self._stack[-1] if self._stack else ("", None, -1)
        self._block = Block(tag, kind, doubt)

    def _put(self, raw: str) -> None:
        if raw and not self._skip:
            self._block.parts.append(raw)
            if self._links:
                self._block.linked += len("".join(raw.split()))

    def _leave(self, to: int) -> None:
        """Close the open elements from position ``to`` on."""
        cut = False
        while len(self._stack) > to:
            name = self._stack.pop()[0]
            self._places[name].pop()
            if name in BLOCKS:
                self._open_blocks.pop()
                cut = True
            self._links -= name == "a"
            self._skip -= name in SKIPPED
        if cut:
            self._flush(self._stack[self._open_blocks[-1]][0] if self._open_blocks else "body")

    def _last(self, names) -> int:
        return max((self._places[n][-1] for n in names if self._places.get(n)), default=-1)

    def _close(self, names, stop=()) -> None:
        """Close the innermost open element of these names, if none of ``stop`` is inside it."""
        at = self._last(names)
        if at >= 0 and at > self._last(stop):
            self._leave(at)

    def _open(self, tag: str, attrs: str) -> None:
        _, inside, doubt = self._stack[-1] if self._stack else ("", None, -1)
        kind = BAD if inside == BAD else _kind(tag, attrs, inside == GOOD) or inside
        if kind == DOUBT:
            self.around.append(doubt)
            self.in_article.append(inside == GOOD)
            self.holds.append(0)
            kind, doubt = inside, len(self.around) - 1
        elif tag in ARTICLE and kind == GOOD and inside != GOOD:
            self.articles += 1
            if doubt >= 0:
                self.holds[doubt] += 1
        if tag in BLOCKS:
            self._open_blocks.append(len(self._stack))
        self._places.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, kind, doubt))
        if tag in BLOCKS:
            self._flush(tag)
        self._links += tag == "a"
        self._skip += tag in SKIPPED

    def _read(self, page: str) -> None:
        at = 0
        while at < len(page):
            m = _TAG.search(page, at)
            if m is None:
                tail = page.find("<", at)  # a tag that the page's end cuts off
                cut = tail if tail >= 0 and re.match(r"</?[a-zA-Z]", page[tail:tail + 3]) else len(page)
                self._put(page[at:cut])
                break
            self._put(page[at:m.start()])
            at = m.end()
            close, tag, attrs = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
            if not tag:
                continue
            if close:
                self._close((tag,), ("td", "th", "li") if tag in ("p", "b", "i") else ())
                continue
            if tag in BLOCKS:
                self._close(_CLOSES.get(tag, ("p",)), _STOPS)
            if tag == "br":
                self._put("\n")
                continue
            if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
                if tag == "hr":
                    self._flush(self._stack[-1][0] if self._stack else "body")
                continue
            self._open(tag, attrs)
            if tag in RAW:  # their content is no markup
                end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
                self._leave(len(self._stack) - 1)
        self._flush("body")


#: What a new block ends, and the elements beyond which it ends nothing.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
_STOPS = ("ul", "ol", "table", "dl", "article", "section", "div", "nav", "blockquote", "form", "footer", "aside", "main")


def blocks(page: str) -> list[tuple[str, str, str | None, float]]:
    """(text, tag, kind, link density) of each non-empty block in page order."""
    return [(*b[:3], b[3]) for b in Page(page).blocks]


def weight(text: str) -> int:
    """Characters, those of scripts without spaces threefold."""
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def stop_words(text: str) -> tuple[int, int]:
    words = text.lower().split()
    return sum(w in STOP_WORDS or w.strip(".,;:!?\"'()") in STOP_WORDS for w in words), len(words)


def classify(text: str, tag: str, kind: str | None, links: float, covered: bool = True, stops: tuple[int, int] | None = None) -> str:
    """Pass 1: one block on its own. ``covered``: the stop words are of the page's language;
    ``stops``: the block's stop words and words, where they have been counted."""
    if kind == BAD or links > 0.8:
        return BAD
    score = 2 if kind == GOOD else 0
    if links > LINKS:
        score -= 3 if kind is None or tag in ("li", "div", "td") else 1
    elif tag not in HEADINGS and weight(text) >= SHORT:
        found, words = stops or stop_words(text)
        long, share = weight(text) >= LONG, found / words
        if share >= STOPS or share >= SOME_STOPS and long:
            score += 2
        elif long:
            score += -1 if covered else 1
    if kind is None and "\xa9" in text[:3] and weight(text) < LONG:
        score -= 2
    return GOOD if score > 0 else BAD if score < 0 else OPEN


def stop_counts(found: list[tuple]) -> tuple[list[tuple[int, int] | None], bool]:
    """Stop words and words of the longer blocks with few links, and whether the list covers
    the page: its words occur in those blocks at all."""
    counts = [stop_words(b[0]) if b[3] <= LINKS and weight(b[0]) >= SHORT else None for b in found]
    known = [c for c in counts if c]
    return counts, sum(c for c, _ in known) >= COVERED * sum(n for _, n in known)


def doubts(page: Page, labels: list[str]) -> list[bool]:
    """Which doubtful elements lose their text: all but those outside of any article that
    hold every article of the page or, on a page without, nearly all its good text."""
    inside, holds, total = [0] * len(page.around), list(page.holds), 0
    for (text, _, _, _, doubt), label in zip(page.blocks, labels):
        if label == GOOD:
            total += len(text)
            if doubt >= 0:
                inside[doubt] += len(text)
    for i in range(len(page.around) - 1, -1, -1):  # what is around comes first
        if page.around[i] >= 0:
            inside[page.around[i]] += inside[i]
            holds[page.around[i]] += holds[i]
    lost = []
    for i in range(len(page.around)):
        whole = holds[i] == page.articles if page.articles else total and inside[i] >= MOST * total
        lost.append(page.in_article[i] or not whole)
    return lost


def settle(labels: list[str], tags: list[str]) -> list[bool]:
    """Pass 2: open blocks inherit from the nearest decided neighbours."""
    n = len(labels)
    before, after = [-1] * n, [n] * n
    for i in range(1, n):
        before[i] = i - 1 if labels[i - 1] != OPEN else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if labels[i + 1] != OPEN else after[i + 1]
    out = []
    for i, label in enumerate(labels):
        if label == OPEN:
            a, b = before[i], after[i]
            if a < 0 and b >= n:
                label = BAD if tags[i] in HEADINGS else GOOD
            elif a < 0 or b >= n:
                label = labels[b if a < 0 else a]
            elif i - a == b - i:
                label = labels[b if tags[i] in HEADINGS else a]
            else:
                label = labels[a if i - a < b - i else b]
        out.append(label == GOOD)
    return out


def main_text(page: str | None) -> str:
    read = Page(page or "")
    found = read.blocks
    stops, covered = stop_counts(found)
    labels = [classify(*b[:4], covered, n) for b, n in zip(found, stops)]
    lost = doubts(read, labels)
    for i, up in enumerate(read.around):
        lost[i] = lost[i] or up >= 0 and lost[up]
    labels = [BAD if b[4] >= 0 and lost[b[4]] else label for b, label in zip(found, labels)]
    keep = settle(labels, [b[1] for b in found])
    return "\n\n".join(b[0] for b, ok in zip(found, keep) if ok)


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` without its html, with ``text`` and ``n_chars`` (code points)."""
    rest = [c for c in df.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(len(rest))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(rest)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*rest, "text", "n_chars"])

    schema = StructType([*df.select(*rest).schema, StructField("text", StringType()), StructField("n_chars", LongType())])
    return map_arrow(df.select(*rest, html_col), run, schema)
