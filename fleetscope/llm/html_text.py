"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. Pass 1 decides what it can: blocks inside page furniture (menus,
footers, forms, adverts, comments and so on, told by tag, class, id or role) are bad. Elsewhere length, stop-word density
and the share of link text make a block good, bad or undecided. Inside an article or main element the tag is a prior:
text of some length or density is good there, runs of short list items that are nothing but links are bad, and what is
left (headings, short or link-heavy blocks) is undecided. Pass 2 gives each undecided block the label that its nearest
decided neighbours of the same region share; where they differ, the label of the nearer one, good at a tie or without
any. Character references are decoded, white space in a block becomes one space and the good blocks are joined by line
feeds, whole.

A class or id name is furniture if all its words are names of furniture or mere places ("main-menu", "cookieNotice", not
"comment-free"). An inline element with such a name makes a block furniture only where it holds the block's whole text.

Tags are read forward in one pass: no part of a page is searched again because a quote, ``>`` or end tag is missing, so the
time grows with the length of the page whatever is broken. End tags of p, li, dt, dd, option and table parts may be left
out; a p, li and so on ends with its parent.

Defined cases: null and empty html give the empty text; broken markup (unclosed tags, quotes or comments) is read as far
as it goes; a script, style or other raw text that never ends takes the rest of the page, a drawing, button or the like only
its own tag; a page without any tag is one block and kept if pass 1 does not call it bad; repeated rows give a row each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements and naming habits of HTML pages, and frequent words of four languages.
RAW = frozenset("script style noscript iframe textarea title".split())
EMBEDDED = frozenset("template svg math object select canvas audio video button".split())
FURNITURE = frozenset("nav aside footer form head menu dialog fieldset".split())
CONTENT = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: Elements that end where one of their kind begins, unless one of the named lists or tables was opened in between.
OPTIONAL = {
    **dict.fromkeys(("li",), (("li",), ("ul", "ol", "menu"))),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
    **dict.fromkeys(("option", "optgroup"), (("option",), ())),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("table", "tr"))),
    **dict.fromkeys(("tr",), (("tr",), ("table",))),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot"), ("table",))),
}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disqus footer login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted "
    "related respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
PLACES = frozenset(
    "area article bar bottom box block button buttons container content form global header inner item items left link links list "
    "main outer page panel post posts primary right secondary section site top wrap wrapper".split()
)
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his from are this or at an which had but have were they you "
    "der die das und ist von zu den mit für im dem nicht ein eine auch auf als an es sich des bei oder nach "
    "le la les de des et en un une du est que dans qui pour par sur au pas avec il ce ne se plus "
    "el los las del que y en por con una para su al lo como se más no es".split()
)

LINK_SHARE = 0.5
SHORT = 70
LONG = 200
STOP_LOW = 0.15
STOP_HIGH = 0.25

LINK_RUN = 3

_SPECIAL = re.compile(r">|=\s*([\"'])")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_END = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])[^>]*>?", re.I) for name in (*RAW, *EMBEDDED)}


def _furniture(attributes: str) -> str:
    """'hidden', 'named' (its class, id or role is that of page furniture) or ''."""
    out = ""
    if not _TELLING.search(attributes):
        return out
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NOT_SHOWN.search(value):
            return "hidden"
        if name in ("class", "id", "role"):
            for token in value.split():
                words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if w]
                if not FURNITURE_NAMES.isdisjoint(words) and all(w in FURNITURE_NAMES or w in PLACES for w in words):
                    out = "named"
    return out


class _Reader:
    """The tokens of a page. What was searched for in vain, or found far ahead, is not searched for again."""

    def __init__(self, page: str):
        self.page = page
        self.ahead: dict[str, int] = {}
        self.special = None
        self.special_from = -1
        self.dead: set[int] = set()

    def find(self, what: str, at: int) -> int:
        """The first place of ``what`` from ``at`` on, or the length of the page; ``at`` never goes back."""
        known = self.ahead.get(what, -1)
        if known < at:
            known = self.page.find(what, at)
            known = self.ahead[what] = len(self.page) if known < 0 else known
        return known

    def tag_end(self, at: int) -> int:
        """The place after the ``>`` that ends a tag, given a place inside it; -1 if a quote or the tag never ends.

        Places after closed quotes from which no end was found are remembered: each part of a page is passed once by
        tags that fail, however many start before it.
        """
        passed = []
        first = True
        while at not in self.dead:
            if first and self.special_from <= at and self.special is not None and at <= self.special.start():
                m = self.special
            else:
                m = _SPECIAL.search(self.page, at)
                if first:
                    self.special, self.special_from = m, at
                    if m is None:
                        self.dead.add(at)
            if m is None:
                break
            if m.group(1) is None:
                return m.end()
            shut = self.page.find(m.group(1), m.end())
            if shut < 0:
                break
            first = False
            at = shut + 1
            passed.append(at)
        self.dead.update(passed)
        return -1

    def tokens(self) -> Iterator[tuple[str, str, str]]:
        """(kind, name, text): 'text' with its characters, 'open' and 'close' with name and attributes, 'raw' with name."""
        page, at, n = self.page, 0, len(self.page)
        no_end: set[str] = set()
        while at < n:
            if page[at] != "<":
                stop = self.find("<", at)
                yield "text", "", page[at:stop]
                at = stop
                continue
            if page.startswith("<!--", at):
                at = min(n, self.find("-->", at + 4) + 3)
                continue
            named = _NAME.match(page, at)
            if named is None:
                if page.startswith(("<!", "<?", "</"), at) and (stop := self.find(">", at)) < n:
                    at = stop + 1
                else:
                    yield "text", "", "<"
                    at += 1
                continue
            name, closing = named.group(1).lower(), page[at + 1] == "/"
            stop = -1 if self.find(">", at) == n else self.tag_end(named.end())
            if stop < 0:  # not a tag: what stands before the next one is passed over
                stop = min(self.find("<", at + 1), self.find(">", at + 1) + 1, n)
                at = stop
                continue
            if not closing and name in _END:
                end = None if name in no_end else _END[name].search(page, stop)
                if end is None:
                    no_end.add(name)
                if end is None and name in RAW:
                    return
                at = end.end() if end else stop
                yield "raw", name, ""
                continue
            yield "close" if closing else "open", name, page[named.end() : stop - 1]
            at = stop


class _Open:
    """The open block elements and where the innermost of each name stands."""

    def __init__(self):
        self.stack: list[tuple[str, str]] = []
        self.where: dict[str, list[int]] = {}

    def last(self, *names: str) -> int:
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=-1)

    def push(self, name: str, spot: str) -> None:
        self.where.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, spot))

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.where[self.stack.pop()[0]].pop()

    def spot(self) -> str:
        return self.stack[-1][1] if self.stack else ""


def blocks(page: str) -> list[tuple[str, float, str, str]]:
    """(text, share of link characters, where, tag) of each block; where is 'furniture', 'content' or ''."""
    out: list[tuple[str, float, str, str]] = []
    text: list[str] = []
    links = marked = 0
    in_link = False
    opened = _Open()
    inline, mark, depth = "", "", 0  # the open inline element that is hidden or named like furniture

    def flush() -> None:
        nonlocal links, marked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                whole = sum(map(len, joined.split(" ")))
                spot = "furniture" if marked >= whole else opened.spot()
                out.append((joined, min(1.0, links / len(joined)), spot, opened.stack[-1][0] if opened.stack else ""))
            text.clear()
        links = marked = 0

    for kind, name, rest in _Reader(page).tokens():
        if kind == "text":
            if mark == "hidden":
                continue
            shown = html.unescape(rest)
            text.append(shown)
            if in_link:
                links += len(" ".join(shown.split()))
            if mark:
                marked += sum(map(len, shown.split()))
            continue
        if kind == "raw":
            text.append(" ")
            continue
        if name not in BLOCKS:
            if name == "a":
                in_link = kind == "open"
            if name in ("br", "img"):
                text.append(" ")
            if name in VOID:
                continue
            if mark:
                depth += (kind == "open") - (kind == "close") if name == inline else 0
                mark = mark if depth else ""
            elif kind == "open" and rest:
                inline, mark, depth = name, _furniture(rest), 1
            continue
        flush()
        in_link, mark = False, ""
        if kind == "close":
            bound = opened.last(*CONTENT, "body")
            at = opened.last(name)
            if at >= 0 and (at >= bound or name in CONTENT or name in ("body", "html")):
                opened.cut(at)
            continue
        if (at := opened.last("p")) >= 0 and at == len(opened.stack) - 1:
            opened.cut(at)
        if name in ("html", "body"):
            if (at := opened.last("head")) >= 0:
                opened.cut(at)
            continue
        if name in OPTIONAL:
            same, lists = OPTIONAL[name]
            at = opened.last(*same)
            if at > opened.last(*lists, *CONTENT):
                opened.cut(at)
        if name in VOID:
            continue
        spot = opened.spot()
        if spot != "furniture":
            if _furniture(rest) or name in FURNITURE or name == "header" and spot != "content":
                spot = "furniture"
            elif name in CONTENT:
                spot = "content"
        opened.push(name, spot)
    flush()
    return out


def _density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(text: str, links: float, where: str, tag: str = "") -> str:
    """'good', 'bad', 'short' (undecided) or 'link' (undecided, a list item that is nothing but links)."""
    if where == "furniture":
        return "bad"
    if where == "content":
        if links > LINK_SHARE:
            return "link" if tag == "li" and links >= 0.9 and len(text) < SHORT and _density(text) < STOP_HIGH else "short"
        return "good" if len(text) >= SHORT or _density(text) >= STOP_LOW else "short"
    if links > LINK_SHARE:
        return "bad"
    if len(text) < SHORT:
        return "bad" if links else "short"
    stop = _density(text)
    if stop >= STOP_HIGH or stop >= STOP_LOW and len(text) >= LONG:
        return "good"
    return "short" if stop >= STOP_LOW else "bad"


def second_pass(labels: list[str]) -> list[bool]:
    """Whether each block stays: undecided blocks take after their nearest decided neighbours."""
    n = len(labels)
    before: list[tuple[int, str] | None] = [None] * n
    after: list[tuple[int, str] | None] = [None] * n
    seen = None
    for i in range(n):
        if labels[i] != "short":
            seen = (i, labels[i])
        before[i] = seen
    seen = None
    for i in range(n - 1, -1, -1):
        if labels[i] != "short":
            seen = (i, labels[i])
        after[i] = seen
    out = []
    for i, label in enumerate(labels):
        if label != "short":
            out.append(label == "good")
            continue
        near = [(abs(i - x[0]), x[1] != "good") for x in (before[i], after[i]) if x]
        out.append(not min(near)[1] if near else True)
    return out


def kept_blocks(found: list[tuple[str, float, str, str]]) -> list[bool]:
    """Whether each block of :func:`blocks` stays. Blocks inside articles and those outside are regions of their own."""
    labels = [first_pass(*b) for b in found]
    i = 0
    while i < len(labels):  # a run of link items is a menu, a single one may be part of the text
        j = i
        while j < len(labels) and labels[j] == "link":
            j += 1
        labels[i:j] = ["bad" if j - i >= LINK_RUN else "short"] * (j - i)
        i = max(j, i + 1)
    stays = [False] * len(found)
    for content in (True, False):
        at = [i for i, b in enumerate(found) if (b[2] == "content") == content]
        for i, stay in zip(at, second_pass([labels[i] for i in at]), strict=True):
            stays[i] = stay
    return stays


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    stays = kept_blocks(found)
    return "\n".join(b[0] for b, s in zip(found, stays, strict=True) if s)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
