"""Main text of web pages by text-to-tag ratio.

The standard library's streaming parser turns a page into lines, one for each block of text, with the number of tags and
of linked characters in it. The ratio of text to tags is smoothed over neighbouring lines with a Gaussian, and a threshold
splits the lines into two clusters. What the dense lines hold beside links is a region's mass, and masses decide:

* A region that calls itself a menu, footer, advert, sidebar, comment and so on is left out, unless it wraps the text: it
  holds an article with more than all that is outside, or is the largest such region with next to nothing outside (forms
  and names that may mean something else only). A name among other words (has-sidebar, comments-open) leaves out only a small region without an article.
* Of the rest, the articles or the main element are the content if they hold half the mass; else the lowest region that
  holds nearly all of it, with the lines of the regions around it that stand right before or after it.

The content's lines are returned whole, sparse ones too; only outside of articles, link lists before the first dense line,
after the last and in long runs are taken for menus. Scripts, styles, controls and hidden elements are never text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

SIGMA, RADIUS = 1.0, 3
KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
#: Share of the dense text that makes a region the page's text, and that a lowest common region holds.
MOST, NEARLY_ALL = 0.5, 0.95
#: The largest region named as boilerplate is kept if it has so many characters, and less than this share of them is outside.
LEAST_CHARS, OUTSIDE = 200, 0.1
#: A region with a listed name among other words is left out below this share of the dense text.
SMALL = 0.25
#: Ratios whose two clusters differ by less than this factor are one.
APART = math.log(2.5)
#: So many lines of links in a row are a menu.
MENU = 4
#: A menu's links have fewer characters each.
MENU_CHARS = 40

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("head script style noscript template button select textarea iframe svg canvas object title".split())
BESIDE = frozenset("nav footer aside menu".split())
REGIONS = frozenset("article main section div body td".split())
NAMED = frozenset(
    "ad ads adbox advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation "
    "newsletter notice notification pagination popup promo promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split()
)
#: Names of these are as good as an element: they never wrap an article's text.
SURE = frozenset("ad ads adbox advert adverts advertisement adsense breadcrumb breadcrumbs comment comments commentlist cookie cookies disqus footer gdpr menu nav navbar navigation pagination replies respond sidebar".split())
#: Words that add nothing to a name.
PLAIN = frozenset("the site page main top bottom left right primary secondary global list box block area section wrapper wrap container inner outer content bar item items links link posts post articles stories buttons button slot unit form bottom group panel row col text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TOKEN = re.compile(r"[a-z0-9]+")

#: How a region is suspected: not, by a name among other words, by its name, as a form, by its element or role.
NOT, HINT, NAME, FORM, ELEMENT = range(5)


def _named(attrs: list, header: bool) -> int:
    found = NOT
    for name, value in attrs:
        if name == "role" and value in ROLES:
            return FORM if value == "form" else ELEMENT
        if value and name in ("class", "id"):
            for token in value.lower().split():
                words = [w for w in _TOKEN.findall(token) if w not in PLAIN]
                listed = sum(w in NAMED or header and w == "header" for w in words)
                if listed:
                    found = max(found, HINT if listed < len(words) else ELEMENT if any(w in SURE for w in words) else NAME)
    return found


class _Page(HTMLParser):
    """Events to lines: (segments of (region, text), tags, linked characters, region of the block, links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []
        self.open: dict[str, list[int]] = {}  # where a tag stands in the stack
        self.blocks: list[int] = []
        self.skip, self.region, self.links, self.within = False, 0, 0, 0
        self.parents, self.kinds, self.suspects = [0], ["body"], [NOT]
        self.lines: list[tuple[list[tuple[int, str]], int, int, int, int]] = []
        self.parts: list[tuple[int, str]] = []
        self.tags = self.linked = self.anchors = 0

    def flush(self) -> None:
        if self.parts:
            if any(not t.isspace() for _, t in self.parts):
                self.lines.append((self.parts, self.tags, self.linked, self.region, self.anchors))
            self.parts = []
        self.tags = self.linked = self.anchors = 0

    def _suspect(self, tag: str, attrs: list) -> int:
        if tag in BESIDE or tag == "header" and not self.within:
            return ELEMENT
        if tag in ("html", "body", "main"):
            return NOT
        return max(FORM if tag == "form" else NOT, _named(attrs, not self.within)) if attrs or tag == "form" else NOT

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
            if self.stack and self.stack[-1][0] == "p" or tag == "p" and any(x[0] == "p" for x in self.stack[-4:]):
                self._end("p")
            if tag == "li" and self.stack and self.stack[-1][0] == "li":
                self._end("li")
        elif tag == "br":
            self.parts.append((self.region, "\n"))
        self.tags += 1
        if tag in VOID:
            return
        at = len(self.stack)
        self.stack.append((tag, self.skip, self.region))
        self.open.setdefault(tag, []).append(at)
        if tag in BLOCKS or tag in NEVER:
            self.blocks.append(at)
        if not self.skip:
            given = {n for n, _ in attrs}
            self.skip = tag in NEVER or "hidden" in given or ("aria-hidden", "true") in attrs or tag == "dialog" and "open" not in given
        if not self.skip and ((suspect := self._suspect(tag, attrs)) or tag in REGIONS):
            self.parents.append(self.region)
            self.kinds.append(tag)
            self.suspects.append(suspect)
            self.region = len(self.parents) - 1
        self.links += tag == "a"
        self.anchors += tag == "a"
        self.within += tag in ("article", "main")

    def _end(self, tag: str) -> None:
        places = self.open.get(tag)
        if not places:
            return
        i = places[-1]
        # an inline end tag doesn't reach out of its block
        if tag not in BLOCKS and tag not in NEVER and self.blocks and self.blocks[-1] > i:
            return
        for name, _, _ in self.stack[i:]:
            self.links -= name == "a"
            self.within -= name in ("article", "main")
            self.open[name].pop()
        while self.blocks and self.blocks[-1] >= i:
            self.blocks.pop()
        _, self.skip, self.region = self.stack[i]
        del self.stack[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        self._end(tag)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append((self.region, data))
            if self.links:
                self.linked += len(data)


def smoothed(ratios: list[float]) -> list[float]:
    out = []
    for i in range(len(ratios)):
        lo, hi = max(0, i - RADIUS), min(len(ratios), i + RADIUS + 1)
        k = KERNEL[lo - i + RADIUS : hi - i + RADIUS]
        out.append(sum(a * b for a, b in zip(k, ratios[lo:hi], strict=True)) / sum(k))
    return out


def threshold_of(values: list[float]) -> float:
    """Between two clusters of logarithms: the mean of their means, until it rests; below all if the means are within APART."""
    cut = sum(values) / len(values)
    for _ in range(20):
        low, high = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not low or not high or sum(high) / len(high) - sum(low) / len(low) < APART:
            return -1.0
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def _plain(segments: list[tuple[int, str]]) -> str:
    return " ".join("".join(t for _, t in segments).split())


class _Weighed:
    """Lines that are left, which of them are dense, and the dense text beside links (all text: chars) that each region holds."""

    def __init__(self, page: _Page, lines: list) -> None:
        self.texts = [_plain(x[0]) for x in lines]
        self.linked = [min(x[2], len(t)) for x, t in zip(lines, self.texts, strict=True)]
        ratios = [math.log1p(v) for v in smoothed([len(t) / (1 + x[1]) for x, t in zip(lines, self.texts, strict=True)])]
        cut = threshold_of(ratios)
        self.dense = [v >= cut for v in ratios]
        self.mass, self.chars = [0.0] * len(page.parents), [0.0] * len(page.parents)
        for x, t, k, d in zip(lines, self.texts, self.linked, self.dense, strict=True):
            share = (len(t) - k) / max(1, sum(len(p) for _, p in x[0]))
            for r, p in x[0]:
                self.chars[r] += len(p) * share
                self.mass[r] += len(p) * share * d
        for r in range(len(self.mass) - 1, 0, -1):  # a region is numbered after the one that holds it
            self.mass[page.parents[r]] += self.mass[r]
            self.chars[page.parents[r]] += self.chars[r]


def _left_out(page: _Page, w: _Weighed) -> list[bool]:
    """Which regions are left out, with all that they hold."""
    n = len(page.parents)
    strong, anchor, articles = [False] * n, [False] * n, 0
    for r in range(1, n):
        strong[r] = strong[page.parents[r]] or page.suspects[r] > HINT
        articles += page.kinds[r] in ("article", "main") and not strong[r]
    tops = [r for r in range(1, n) if strong[r] and not strong[page.parents[r]]]
    outside, around = w.mass[0] - sum(w.mass[r] for r in tops), w.chars[0] - sum(w.chars[r] for r in tops)
    largest = max((w.chars[r] for r in tops if page.suspects[r] in (NAME, FORM)), default=0.0)
    for r in range(n - 1, 0, -1):
        # an article makes its wrapper more than its name says, unless it is named itself or there is as much text without it
        if page.kinds[r] in ("article", "main") and page.suspects[r] <= HINT and w.chars[r] > 0:
            anchor[r] |= not strong[r] or w.mass[r] >= outside
        anchor[page.parents[r]] |= anchor[r]
    gone = [False] * n
    for r in range(1, n):
        m, s = w.mass[r], page.suspects[r]
        wraps = s in (NAME, FORM) and w.chars[r] >= max(LEAST_CHARS, largest) and around < OUTSIDE * w.chars[r] and not articles
        kept = anchor[r] or s == HINT and m >= SMALL * (outside + m) > 0 or wraps
        gone[r] = gone[page.parents[r]] or s != NOT and not kept
    return gone


def _content(page: _Page, w: _Weighed, gone: list[bool]) -> tuple[list[bool], list[bool], bool]:
    """Regions that are content, regions whose own lines are, and whether the content is marked as an article."""
    total, n = w.mass[0], len(page.parents)
    none = [False] * n

    def under(kind: str) -> list[int]:
        held = [False] * n
        tops = []
        for r in range(1, n):
            up = page.parents[r]
            held[r] = held[up] or page.kinds[up] == kind and up > 0
            if page.kinds[r] == kind and not held[r] and not gone[r] and w.chars[r] > 0:
                tops.append(r)
        return tops

    def spread(tops: list[int]) -> list[bool]:
        member, top = none[:], set(tops)
        for r in range(n):
            member[r] = not gone[r] and (r in top or r > 0 and member[page.parents[r]])
        return member

    share = lambda tops: sum(w.chars[r] for r in tops) / w.chars[0] if tops and w.chars[0] else 0.0
    articles, mains = under("article"), under("main")
    for tops, least in ((articles, 0.9), (mains, MOST), (articles, MOST)):
        if share(tops) >= least:
            return spread(tops), none, True
    lowest = max((r for r in range(n) if not gone[r] and w.mass[r] >= NEARLY_ALL * total), default=0) if total else 0
    beside, r = none[:], lowest
    while r:
        r = page.parents[r]
        beside[r] = True
    return spread([lowest]), beside, False


def main_text(html: str | None) -> str:
    """Blocks of the main text, joined by two line feeds; empty if the page has none."""
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    if not page.lines:
        return ""
    gone = _left_out(page, _Weighed(page, page.lines))
    lines = [([s for s in x[0] if not gone[s[0]]], *x[1:]) for x in page.lines]
    at = [i for i, x in enumerate(lines) if any(not t.isspace() for _, t in x[0])]
    lines = [lines[i] for i in at]
    if not lines:
        return ""
    w = _Weighed(page, lines)
    member, beside, marked = _content(page, w, gone)
    links = [k > 0.5 * len(t) and k < MENU_CHARS * x[4] for x, t, k in zip(lines, w.texts, w.linked, strict=True)]
    take = [member[x[0][0][0]] or member[x[3]] for x in lines]
    if not marked:
        # lines beside the content, as far as nothing stands between
        for way in (range(1, len(lines)), range(len(lines) - 2, -1, -1)):
            d = way.step
            for i in way:
                if beside[lines[i][3]] and not links[i] and not take[i] and take[i - d] and at[i] - at[i - d] == d:
                    take[i] = True
        firm = [i for i, d in enumerate(w.dense) if d and take[i] and not links[i]]
        low, high = (firm[0], firm[-1]) if firm else (len(lines), -1)
        run = 0
        for i in range(len(lines) + 1):
            if i < len(lines) and links[i] and not w.dense[i]:
                run += 1
                continue
            for k in range(i - run, i):
                take[k] = take[k] and run < MENU and low < k < high
            run = 0
    return "\n\n".join(t for t, k in zip(w.texts, take, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html), without a shuffle.

    A null or empty html has an empty text; a page is parsed whole, in time and memory linear in its length, however deep or
    broken its markup is. Null ids and urls stay null, repeated rows give repeated rows, an empty table
    none; other columns are not read. n_chars counts code points."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
