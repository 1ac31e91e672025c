"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. The lengths of lines are summed over a sliding
window; where a window's sum rises to the level of running text is a surge point, where it falls below a dive point, and what lies
between is a run of text. The level is `RISE` of the page's densest window, LINE characters at most, so menus, captions and
other short lines far from running text lie outside all runs. The longest run is kept, those with `share` of its text, those
in its container, those with running text in a container beside that one, and those between kept ones; within them all lines stay, however short.

Tags and classes only weigh the lines before that: lines of navigation, notices, adverts, forms and readers' comments weigh nothing, as do
lines that are mostly links, and so part runs; but a container that holds most of the page's text keeps its weight whatever it is
called. Where <article> (or else <main>) holds most of the text, its lines weigh LINE at least and lines outside a tenth.

Defined results: null, empty and textless pages give an empty text; unclosed and truncated markup is
read as far as it goes; a page takes time in proportion to its length; repeated rows give repeated results; nothing is dropped or
capped by length; an empty table gives an empty result; columns other than page_id, url and html are left alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

WINDOW = 3
SHARE = 0.25
RISE = 0.1
LINE = 40
MOST_OF = 0.5
OUTSIDE = 0.1
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"'=]|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=\s*[^\s>"'][^\s>]*|["'=])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)|(?=[\s/]|$))""", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "xmp", "noembed", "noframes"}
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*(?:>|\Z)", re.I) for tag in _RAW}
_MAY_CLOSE_ITSELF = {"svg", "math", "object", "iframe"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINERS = set("article aside body center details div fieldset footer form header main nav section table td".split())
_SIDE_TAGS = set("head nav footer aside form menu dialog select button datalist audio video canvas".split())
_SIDE_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: parts of class names and ids, as wholes: of what is beside the text, and of what readers wrote
_SIDE = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead topbar cookie cookies "
    "consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login related recommended recommendations share sharing social widget widgets toolbar pagination pager legal copyright disclaimer skip search toc".split()
)
#: of these, the ones that say so as the first part of a name inside an article too; others ("share-price", "promo-code") only where the element is mostly links
_SIDE_FIRST = set("ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored nav navbar navigation sidebar sidebars breadcrumb breadcrumbs cookie cookies consent gdpr newsletter pagination".split())
_SIDE_WHOLE = {"side", "header", "site-header", "page-header"}
_READERS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "responses"}
#: a name that begins so tells what a page has or lacks, not what the element is
_TELLS = {"no", "has", "with", "without", "not", "hide", "is"}
_PLAIN = {"html", "body", "main", "h1", "b", "i", "em", "strong"}


@dataclass
class Line:
    text: str
    linked: int  # characters inside links
    side: int  # the innermost element named as beside the text, or -1
    article: int  # the outermost article, or -1
    main: bool
    home: int  # the innermost container
    yard: int  # the container around that
    heading: bool

    def of_links(self) -> bool:
        return self.linked * 2 > len(self.text)


class Page:
    """Lines of a page, and the elements named as beside the text: parent, whether readers wrote it,
    whether <main> lies in it, whether it is a form, whether the name alone does not settle it."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.sides: list[list] = []
        self._text: list[str] = []
        self._linked = self._link = self._main = self._elements = 0
        self._side, self._article, self._home, self._yard = -1, -1, 0, 0
        self._stack: list[tuple] = []  # tag and what was so before it opened
        self._open_at: dict[str, list[int]] = {}  # depths of open elements, by tag
        self._blocks: list[int] = []  # depths of open blocks other than p
        self._heading = False
        self._read(page)

    def _flush(self) -> None:
        text = " ".join(unescape("".join(self._text)).split())
        if text:
            self.lines.append(Line(text, self._linked, self._side, self._article, self._main > 0, self._home, self._yard, self._heading))
        self._text, self._linked = [], 0

    def _say(self, text: str) -> None:
        if text:
            self._text.append(text)
            if self._link:
                self._linked += len(text.strip())

    def _named(self, tag: str, attributes: str) -> tuple[bool, bool, bool, bool]:
        """Whether an element is beside the text, written by readers, the main one; and whether it is so by the first part of an ambiguous name."""
        maybe, inside = False, self._article >= 0 or self._main > 0
        side, readers, main = tag in _SIDE_TAGS or (tag == "header" and not self._main and self._article < 0), False, tag == "main"
        if attributes and tag not in _PLAIN:
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name == "role":
                    main |= value == "main"
                    side |= value in _SIDE_ROLES
                elif name in ("class", "id"):
                    for word in value.split():
                        parts = re.split(r"[-_]+", word)
                        ends = set() if parts[0] in _TELLS else {parts[0], parts[-1]}
                        sure = {e for e in ends if not inside or e == parts[-1] or e in _SIDE_FIRST}
                        side |= word in _SIDE_WHOLE or bool(sure & _SIDE)
                        maybe |= bool(ends & _SIDE)
                        readers |= bool(ends & _READERS)
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    side = True
        return side or readers or maybe, readers, main, maybe and not side and not readers

    def _open(self, tag: str, attributes: str) -> None:
        side, readers, main, maybe = self._named(tag, attributes)
        if side or main or tag == "article":
            self._flush()
        self._stack.append((tag, self._side, self._article, self._home, self._yard, main, self._heading))
        self._open_at.setdefault(tag, []).append(len(self._stack) - 1)
        if tag in _BLOCKS and tag != "p":
            self._blocks.append(len(self._stack) - 1)
        self._elements += 1
        if side:
            self.sides.append([self._side, readers, False, tag == "form", maybe])
            self._side = len(self.sides) - 1
        if main:
            self._main += 1
            if self._side >= 0:
                self.sides[self._side][2] = True
        if tag == "article" and self._article < 0:
            self._article = self._elements
        if tag in _CONTAINERS:
            self._home, self._yard = self._elements, self._home
        self._heading |= tag in ("h1", "h2", "h3")
        self._link += tag == "a"

    def _pop(self) -> None:
        tag, side, article, home, yard, main, heading = self._stack.pop()
        if side != self._side or article != self._article or main:
            self._flush()
        self._open_at[tag].pop()
        if self._blocks and self._blocks[-1] == len(self._stack):
            self._blocks.pop()
        self._side, self._article, self._home, self._yard, self._heading = side, article, home, yard, heading
        self._main -= main
        self._link -= tag == "a"

    def _close(self, tag: str) -> None:
        depths = self._open_at.get(tag)
        if not depths:
            return
        if tag not in _BLOCKS and self._blocks and self._blocks[-1] > depths[-1]:
            return  # a stray inline end tag closes no block
        least = depths[-1]
        while len(self._stack) > least:
            self._pop()

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                break
            m = _TOKEN.match(page, lt)
            if m is None:  # a lone "<" is text
                self._say(page[at : lt + 1])
                at = lt + 1
                continue
            self._say(page[at:lt])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag in _BLOCKS:
                    self._flush()
                self._close(tag)
                continue
            if tag in _RAW:
                if tag not in _MAY_CLOSE_ITSELF or not m[3].rstrip().endswith("/"):
                    end = _RAW_ENDS[tag].search(page, at)
                    at = end.end() if end else n
                continue
            if tag in _BLOCKS:
                self._flush()
                if tag != "br":
                    self._close("p")
                if tag == "li" and self._stack and self._stack[-1][0] == "li":
                    self._pop()
            if tag not in _VOID:
                self._open(tag, m[3])
        self._say(page[at:])
        self._flush()


def beside(read: Page) -> list[bool]:
    """For each element named as beside the text, whether its lines weigh nothing.

    An element that an ambiguous name inside an article marks is beside the text if it is mostly links. One that holds <main> is not, nor is one that holds most of the page's text where no article lies
    outside (a form around the page may have a teaser outside); what readers wrote always is.
    """
    held, linked = [0] * len(read.sides), [0] * len(read.sides)
    total = 0
    other = any(x.side < 0 and (x.article >= 0 or x.main) for x in read.lines)
    for x in read.lines:
        n = len(x.text) - x.linked
        total += n
        if x.side >= 0:
            held[x.side] += n
            linked[x.side] += x.linked
    out = [False] * len(held)
    for i in range(len(held) - 1, -1, -1):  # parents come before what they hold
        parent, readers, main, form, maybe = read.sides[i]
        if parent >= 0:
            held[parent] += held[i]
            linked[parent] += linked[i]
            read.sides[parent][2] |= main
        out[i] = readers or (not main and (linked[i] > held[i] if maybe else held[i] <= MOST_OF * total or (other and not form)))
    for i, (parent, *_) in enumerate(read.sides):
        out[i] = out[i] or (parent >= 0 and out[parent])
    return out


def weighed(read: Page) -> tuple[list[float], list[bool]]:
    """The weighted length of every line, and whether a run ends before it: at an article's ends where articles are not the text."""
    off = beside(read)
    there = [x.side < 0 or not off[x.side] for x in read.lines]
    total = sum(len(x.text) for x, t in zip(read.lines, there) if t)
    by_article = sum(len(x.text) for x, t in zip(read.lines, there) if t and x.article >= 0)
    by_main = sum(len(x.text) for x, t in zip(read.lines, there) if t and x.main)
    inside = (lambda x: x.article >= 0) if by_article and by_article >= MOST_OF * total else (lambda x: x.main) if by_main and by_main >= MOST_OF * total else None
    weights = []
    for x, t in zip(read.lines, there):
        n = float(len(x.text))
        if inside is None:
            weights.append(0.0 if not t or x.of_links() else n)
        else:
            weights.append(0.0 if not t else max(n, LINE) if inside(x) else 0.0 if x.of_links() else OUTSIDE * n)
    parts = [inside is None and i > 0 and x.article != read.lines[i - 1].article for i, x in enumerate(read.lines)]
    return weights, parts


def runs(lengths: list[float], window: int = WINDOW, level: float = 0.0) -> list[tuple[int, int]]:
    """Line ranges between surge and dive points: all lines of the windows whose sum is above the level. A line that weighs
    nothing lies in no run."""
    n = len(lengths)
    sums = [0.0, *accumulate(lengths)]
    dense = [0] * (n + 1)  # +1 where a dense window begins, -1 behind its end
    for z in range(1, n + 1):
        a = max(0, z - window)
        if sums[z] - sums[a] > level:
            dense[a] += 1
            dense[z] -= 1
    out, begin = [], None
    for i, c in enumerate([*accumulate(dense[:n]), 0]):
        on = c > 0 and lengths[i] > 0
        if on and begin is None:
            begin = i
        elif not on and begin is not None:
            out.append((begin, i))
            begin = None
    return out


def main_text(page: str | None, window: int = WINDOW, share: float = SHARE, rise: float = RISE) -> str:
    """`rise` 0 switches surge and dive points off: every line that weighs anything is in a run."""
    if not page:
        return ""
    read = Page(page)
    weights, parts = weighed(read)
    # lines that weigh nothing part the runs around them, unless these are of one container; so do ends of articles
    apart: list[int] = []
    for i, w in enumerate(weights):
        if w > 0:
            before = next((k for k in reversed(apart) if k >= 0), None)
            gap = before is not None and (any(parts[before + 1 : i + 1]) or (before < i - 1 and read.lines[before].home != read.lines[i].home))
            apart += [-1] * (window if gap else 0) + [i]
    spread = [weights[i] if i >= 0 else 0.0 for i in apart]
    sums = [0.0, *accumulate(spread)]
    densest = max((sums[z] - sums[max(0, z - window)] for z in range(1, len(sums))), default=0.0)
    level = min(rise * densest, LINE / 2)
    found = [(apart[a:z], sums[z] - sums[a]) for a, z in runs(spread, window, level)]
    if not found:
        return ""
    longest, most = max(found, key=lambda x: x[1])
    held: dict[int, float] = {}
    for i in longest:
        held[read.lines[i].home] = held.get(read.lines[i].home, 0.0) + weights[i]
    home = max(held, key=held.get)
    yard = next(read.lines[i].yard for i in longest if read.lines[i].home == home)
    near = lambda x: x.home == home or (home and x.yard == yard and len(x.text) - x.linked >= LINE)  # noqa: E731  or running text in a container beside it
    good = [size >= share * most or any(near(read.lines[i]) for i in run) for run, size in found]
    first, last = good.index(True), len(good) - 1 - good[::-1].index(True)
    out = []
    for run, _ in found[first : last + 1]:
        if rise:  # short lines of other containers at a run's ends are only near the text
            far = [k for k, i in enumerate(run) if not _only_near(read.lines[i], home)]
            run = run[far[0] : far[-1] + 1] if far else run
        out += [read.lines[i].text for i in run]
    return "\n\n".join(out)


def _only_near(x: Line, home: int) -> bool:
    return len(x.text) < LINE and x.home != home and not x.heading and x.article < 0 and not x.main


def extract(pages: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x, window, share) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
