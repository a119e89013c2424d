"""Main text of web pages: parser events to lines, text-to-tag ratios, smoothing, clustering, content region.

A page is read as a stream of events of the standard library's parser. Every block of the
page is a line with its text, its tags and its linked text. The ratio of text to tags per
line is smoothed with a Gaussian and split in two clusters; the content region is the
smallest element that holds nearly all text of the high cluster, and all of its lines are
kept, short ones too. Elements that never hold the article (menus, forms, notices, ...)
are left out before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
#: Share of the high cluster's text that the content region must hold.
COVER = 0.8
#: A section beside the region belongs to it if it holds this share of the high cluster's text.
LEAST = 0.03
#: Lists of lines with at least this share of linked text are menus.
LINKED = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
SKIPPED = frozenset(
    "aside button canvas dialog footer form head iframe input label map math menu nav noscript object option script select "
    "style svg template textarea title".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends without an end tag, up to the elements in the second set.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Words in a class or id that name a part outside the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie "
    "cookies copyright disclaimer disqus dropdown foot footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination paywall popup promo promoted promotion recommended related reply "
    "replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar toc "
    "widget".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
ASIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
FRAME = frozenset("html body main article".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _named_aside(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name == "hidden":
            return True
        if not value:
            continue
        if name in ("class", "id"):
            words = [w.lower() for w in WORD.findall(value)]
            wanted = COMMENT_WORDS if tag in FRAME else ASIDE_WORDS
            for before, word in zip(["", *words], words):
                if word in wanted and before not in ("has", "with", "no", "without", "show", "hide"):
                    return tag not in ("html", "body")
        elif name == "role":
            if value.strip().lower() in ASIDE_ROLES and tag not in FRAME:
                return True
        elif name == "aria-hidden":
            if value.strip().lower() == "true":
                return True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def _named_comment(attrs: list[tuple[str, str | None]]) -> bool:
    names = " ".join(v for n, v in attrs if n in ("class", "id") and v)
    return any(w.lower() in COMMENT_WORDS for w in WORD.findall(names))


class _Lines(HTMLParser):
    """Collects lines: (text, tags, linked characters, path of element numbers, in a list)."""

    def __init__(self, exempt: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.exempt = exempt  # numbers of elements whose class and id say nothing
        self.named: list[int] = []  # open elements that are left out for their class or id alone
        self.lost: dict[int, int] = {}  # characters left out in each of them
        self.with_article: set[int] = set()  # those that hold an article or its title
        self.stack: list[tuple[str, int, bool]] = []  # tag, number, whether its text is left out
        self.lines: list[tuple[str, int, int, tuple[int, ...], bool]] = []
        self.tags_of: list[str] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                path = tuple(n for _, n, _ in self.stack)
                listed = any(t == "li" for t, _, _ in self.stack)
                self.lines.append((text, self.tags, self.linked, path, listed))
            self.parts.clear()
        self.tags = self.linked = 0

    def pop_to(self, place: int) -> None:
        if any(t in BLOCK for t, _, _ in self.stack[place:]):
            self.flush()
        self.links -= sum(t == "a" for t, _, _ in self.stack[place:])
        gone = {n for _, n, _ in self.stack[place:]}
        self.named = [n for n in self.named if n not in gone]
        del self.stack[place:]

    def find(self, tags: frozenset[str], until: frozenset[str]) -> int | None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                return i
            if self.stack[i][0] in until:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            place = self.find(frozenset(["p"]), _P_STOPS)
            if place is not None:
                self.pop_to(place)
            if tag in ENDS and (place := self.find(*ENDS[tag])) is not None:
                self.pop_to(place)
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        above = bool(self.stack) and self.stack[-1][2]
        if len(self.tags_of) in self.exempt:
            attrs = [a for a in attrs if a[0] not in ("class", "id")]
        aside = _named_aside(tag, attrs)
        out = above or tag in SKIPPED or tag == "header" or aside
        if self.named and tag in ("article", "main", "h1"):
            self.with_article.update(self.named)
        if aside and not above and tag not in SKIPPED and tag != "header" and not _named_aside("body", attrs) and not _named_comment(attrs):
            self.named.append(len(self.tags_of))
            if tag in ("article", "main"):
                self.with_article.add(len(self.tags_of))
        if tag in HEADINGS and above and self._article_header():
            out = False
        self.stack.append((tag, len(self.tags_of), out))
        self.tags_of.append(tag)
        self.links += tag == "a"

    def _article_header(self) -> bool:
        """Whether all that leaves this place out is the article's own header, whose headings belong to the text."""
        outs = [t for t, _, o in self.stack if o]
        return outs[:1] == ["header"] and not any(t in SKIPPED for t in outs) and any(t in ("article", "main") for t, _, _ in self.stack)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop_to(i)
                return
            if self.stack[i][0] in _WALLS and tag not in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][2]:
            for number in self.named:
                self.lost[number] = self.lost.get(number, 0) + len(data.strip())
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


_P_STOPS = frozenset(BLOCK - {"p"})
_WALLS = frozenset(["article", "div", "section", "main", "td", "body"])


def _two_means(values: np.ndarray) -> float:
    """The threshold between two clusters of values; below all values if there is but one."""
    low, high = values.min(), values.max()
    if high - low < 1e-9:
        return low - 1
    for _ in range(50):
        cut = (low + high) / 2
        new = values[values <= cut].mean(), values[values > cut].mean()
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_lines(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Which lines are in the high cluster of the smoothed text-to-tag ratios."""
    reach = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[reach : reach + len(ratios)]
    smooth = np.convolve(ratios, kernel, "full")[reach : reach + len(ratios)] / weight
    return smooth > _two_means(smooth)


def _parse(html: str) -> _Lines:
    """The lines of a page. A name alone leaves no block out that holds an article or a title, and most of the text."""
    exempt: frozenset[int] = frozenset()
    while True:
        parser = _Lines(exempt)
        parser.feed(html)
        parser.close()
        parser.flush()
        kept = sum(len(line[0]) for line in parser.lines)
        most = [n for n, size in parser.lost.items() if n in parser.with_article and size > kept + sum(parser.lost.values()) - size]
        if not most:
            return parser
        exempt |= frozenset(most)


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, joined by an empty line; empty if there is none."""
    if not html:
        return ""
    last = html.rfind("<")
    if last > html.rfind(">") and re.match("<[A-Za-z/!?]", html[last : last + 2]):
        html = html[:last]  # a tag that the page's end cuts
    parser = _parse(html)
    lines = parser.lines
    if not lines:
        return ""
    menu = np.array([listed and linked >= LINKED * len(text.replace(" ", "")) for text, _, linked, _, listed in lines])
    alone = ~(np.r_[False, menu[:-1]] | np.r_[menu[1:], False])
    lines = [line for line, out in zip(lines, menu & ~alone) if not out]
    if not lines:
        return ""
    sizes = np.array([len(line[0]) for line in lines], float)
    chosen = content_lines(sizes / np.array([max(1, line[1]) for line in lines]))
    wanted = float(sizes[chosen].sum())
    held: dict[int, float] = {}
    for line, n, high in zip(lines, sizes, chosen):
        if high:
            for number in line[3]:
                held[number] = held.get(number, 0.0) + n
    # Numbers grow with depth along a path, so the last element with enough text is the smallest.
    enough = [number for number, n in held.items() if n >= COVER * wanted]
    region = max(enough, default=None)
    if region is not None:
        region = _with_siblings(region, [(line[3], n) for line, n, high in zip(lines, sizes, chosen) if high], parser.tags_of, wanted)
        path = next(line[3] for line in lines if region in line[3])
        outer = [n for n in path if parser.tags_of[n] in ("article", "main")]
        inside = [n for n in path if parser.tags_of[n] not in HEADINGS and parser.tags_of[n] in _WALLS and n <= region]
        region = outer[0] if outer else inside[-1] if inside else None
    return "\n\n".join(line[0] for line in lines if region is None or region in line[3])


def _with_siblings(region: int, high: list[tuple[tuple[int, ...], float]], tags: list[str], wanted: float) -> int:
    """The region, widened to its parent while elements beside it, of its own kind, hold high lines worth keeping."""
    while True:
        path = next(p for p, _ in high if region in p)
        place = path.index(region)
        if place < 2 or tags[path[place - 1]] in ("body", "html"):
            return region
        parent = path[place - 1]
        more = sum(n for p, n in high if len(p) > place and p[place - 1] == parent and p[place] != region and tags[p[place]] == tags[region])
        if more < LEAST * wanted:
            return region
        region = parent


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Null and empty pages, and pages without an article, have an empty text. Cut pages,
    unclosed and stray tags are read as far as they go. Ids and urls may be null or
    repeat; an empty table gives no rows; other columns are ignored.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (page_id, url)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h) for h in frame.html]
            yield pd.DataFrame(
                {"page_id": frame.page_id, "url": frame.url, "text": texts, "n_chars": [len(t) for t in texts]}
            )

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInPandas(run, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars long")
