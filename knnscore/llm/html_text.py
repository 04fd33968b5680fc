"""Main text of web pages from streaming parser events, text-to-tag ratios and clustering.

The standard library's parser emits events; they are gathered into lines (the text between two block-level
tags). A line's ratio is its characters over its tags; ratios are smoothed by a Gaussian over neighbouring
lines, and lines at or above the standard deviation of the smoothed ratios form the content cluster. The
region is the article (or main) element with most of the cluster's text, if that is half of it, else the innermost element with
nearly all of it; every line of the region is content. Where no element but the page's body holds the cluster,
the lines from the first to the last whose own ratio is as high, with a heading right before, are content.

Elements that name themselves menus, page headers, footers, sidebars, notices, adverts, forms, comments and the like, by their tag, role or a
whole class or id, have ratio zero and never count, but for wrappers: what is left out is decided after the page is read, by where its
text and its article are (``left_out``). Inside an article whole boxes alone go (``BOXES`` whose class or id is such a name),
never headings, paragraphs, or an article's own header.

Defined results: null or empty html gives an empty text; broken and unclosed markup is read on: what follows the last ``>`` is
text; a page is read whole in one task, in time and memory proportional to its length; of equally heavy regions the first or innermost
counts; repeated rows give repeated results; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import pieces

# Element names of HTML and what pages call their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul br caption".split()
)
UNSEEN = frozenset("head title script style noscript template iframe svg canvas object audio video button select textarea datalist".split())
BESIDE = frozenset("nav header footer aside form dialog menu".split())
#: A class or id that is one of these names, as a whole: with a place before it, and a kind of box after it.
NAMED = (
    "ads?|adverts?|advertisements?|advertising|banners?|comments?|commentlist|disqus|newsletter|pagination|pager|promos?|promoted|recommended|related|respond|share|sharing|sidebars?|social|"
    "sponsor(?:ed|s)?|subscribe|cookies?|consent|gdpr|toolbar"
)
OUTSIDE = f"{NAMED}|alerts?|breadcrumbs?|footers?|headers?|masthead|menus?|modal|nav|navbar|navigation|notices?|popup|skip|widgets?"
PLACE = "(?:site|page|main|top|bottom|global|primary|secondary|left|right|post|entry|article|blog|mobile|sub|user|cookie|social|header|footer|nav|sticky|fixed)"
BOX = "(?:area|articles|bar|block|box|buttons?|container|content|form|icons?|inner|items|links?|list|main|menu|notice|posts|primary|section|secondary|slot|stories|thread|top|unit|widgets?|wrap|wrapper)"
PART, INSIDE = (re.compile(rf"(?:{PLACE}[_-]?)?(?:{names})(?:[_-]?{BOX})?(?:[_-]?\d+)?", re.IGNORECASE) for names in (OUTSIDE, NAMED))
BOXES = frozenset("aside div section ul ol dl table figure".split())
LOOSELY, BY_CLASS, BY_NAME, ALWAYS = 1, 2, 3, 4  # why an element may be left out
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())  # may be named after a header and are none
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Opening one of these closes an open one of the same list, up to the nearest list or table.
SIBLINGS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("ul ol dl table td th select body article section div main aside nav footer header form".split())
CLOSES_P = BLOCK - {"br", "option", "optgroup", "legend", "summary", "caption"}


class _Lines(HTMLParser):
    """Collects lines: (text, tags, innermost open element or -1). Of each element its name, the number of the one around, and why it may be left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.elements: list[str] = []
        self.parents: list[int] = []
        self.reasons: list[int] = []
        self.open: list[tuple[str, int, int]] = []
        self.names: Counter[str] = Counter()  # of open elements
        self.text: list[str] = []
        self.tags = 0
        self.beside = 0  # open elements that are left out by their own name
        self.failed = 0  # tags that had no end

    def read(self, html: str) -> None:
        """All of a page. What follows the last ``>`` is text, and a comment without an end begins none."""
        end = html.rfind(">") + 1
        last = max((m.end() for m in re.finditer(r"--\s*>", html)), default=0)
        self.feed(html[:last] + html[last:end].replace("<!--", " "))
        self.close()
        self.handle_data(unescape(html[end:]))
        self.end_line()

    def check_for_whole_start_tag(self, i: int) -> int:
        """Where the tag ends, -1 without an end. After some tags without an end, further ones are looked for nearby alone, so that time stays linear."""
        if self.failed < 20:
            found = super().check_for_whole_start_tag(i)
            self.failed += found < 0
            return found
        whole, self.rawdata = self.rawdata, self.rawdata[i : i + 1024]
        found = super().check_for_whole_start_tag(0)
        self.rawdata = whole
        return found + i if found > 0 else found

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def end_line(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                self.lines.append((text, self.tags, self.innermost()))
                self.tags = 0
            self.text = []

    def innermost(self) -> int:
        return self.open[-1][1] if self.open else -1

    def push(self, tag: str, reason: int) -> None:
        self.end_line()
        self.parents.append(self.innermost())
        self.elements.append(tag)
        self.reasons.append(reason)
        self.open.append((tag, len(self.elements) - 1, reason))
        self.names[tag] += 1
        self.beside += reason > BY_CLASS

    def pop_to(self, depth: int) -> None:
        self.end_line()
        for tag, _, reason in self.open[depth:]:
            self.names[tag] -= 1
            self.beside -= reason > BY_CLASS
        del self.open[depth:]

    def close_sibling(self, names: tuple[str, ...]) -> None:
        if not any(self.names[x] for x in names):
            return None
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.open[depth][0]
            if tag in names:
                return self.pop_to(depth)
            if tag in FENCES:
                return None
        return None

    def handle_starttag(self, tag, attrs) -> None:
        self.tags += 1
        block = tag in BLOCK
        if block:
            if tag in CLOSES_P:
                self.close_sibling(("p",))
            if tag in SIBLINGS:
                self.close_sibling(SIBLINGS[tag])
            if tag in VOID:
                if tag == "hr":
                    self.end_line()
                else:
                    self.text.append(" ")
                return
        elif tag in VOID:
            return
        if tag in ("article", "main") and self.beside:  # an unclosed menu doesn't take the article
            depth = next((d for d, x in enumerate(self.open) if x[2] > BY_CLASS), 0)
            if self.open[depth][0] in ("nav", "header"):
                self.pop_to(depth)
        article = (self.names["article"] or self.names["main"]) and not self.beside
        reason = ALWAYS if tag in UNSEEN else BY_NAME if tag in BESIDE and not (article and tag == "header") else 0
        if not reason and tag not in HEADINGS:
            reason = max((self.reason(tag, k, v or "", bool(article)) for k, v in attrs), default=0)
        if block or reason:
            self.push(tag, reason)

    def reason(self, tag: str, attribute: str, value: str, article: bool) -> int:
        """Why an attribute may leave the element out."""
        if attribute in ("class", "id"):
            if article:
                return BY_CLASS if tag in BOXES and any(INSIDE.fullmatch(x) for x in value.split()) else 0
            if not any(PART.fullmatch(x) for x in value.split()) or (tag in ("html", "body", "article", "main") and "comment" not in value.lower()):
                return 0
            return BY_CLASS if any(INSIDE.fullmatch(x) for x in value.split()) else LOOSELY
        if attribute == "role":
            return BY_NAME if value in ROLES else 0
        hidden = attribute == "hidden" or (attribute == "aria-hidden" and value == "true") or (attribute == "style" and "display:none" in value.replace(" ", ""))
        return ALWAYS if hidden else 0

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag) -> None:
        self.tags += 1
        if self.names[tag]:
            return self.pop_to(next(depth for depth in range(len(self.open) - 1, -1, -1) if self.open[depth][0] == tag))
        if tag in BLOCK:
            self.end_line()
        return None

    def handle_data(self, data) -> None:
        self.text.append(data)


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian over neighbours, renormalised at the ends."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[low:high], strict=True)) / sum(weights))
    return out


def sums(parser: _Lines, of: list[float]) -> list[float]:
    """Of each element what its own lines and those of the elements in it add up to; the last entry is for the page."""
    out = [0.0] * (len(parser.elements) + 1)
    for (_, _, element), x in zip(parser.lines, of, strict=True):
        out[element] += x
    for e in range(len(parser.elements) - 1, -1, -1):  # elements come after those around them
        out[parser.parents[e]] += out[e]
    return out


def left_out(parser: _Lines) -> list[bool]:
    """Of each line whether it is in an element that is no content.

    Elements that are unseen always go. Those named as something beside the text go but for two kinds, which are wrappers: one that
    holds an article or main element and half of the page's text, and one (no menu, header, footer or the like by its own tag) beside
    which there is next to no text, a tenth of its own, that isn't itself in such an element; none, if its name says comments, adverts or the like.
    """
    n, parents, reasons = len(parser.elements), parser.parents, parser.reasons
    holds, gone, beside = [False] * n, [False] * n, [False] * n
    for e in range(n - 1, -1, -1):
        if parents[e] >= 0 and (holds[e] or parser.elements[e] in ("article", "main")):
            holds[parents[e]] = True
    for e in range(n):
        up = parents[e]
        gone[e] = reasons[e] == ALWAYS or (up >= 0 and gone[up])
        beside[e] = gone[e] or reasons[e] > 0 or (up >= 0 and beside[up])
    size = [0.0 if element >= 0 and gone[element] else float(len(text)) for text, _, element in parser.lines]
    clean = [0.0 if element >= 0 and beside[element] else x for (_, _, element), x in zip(parser.lines, size, strict=True)]
    mass, free = sums(parser, size), sum(clean)
    for e in range(n):
        if gone[e] or (parents[e] >= 0 and gone[parents[e]]):
            gone[e] = True
        elif reasons[e]:
            loose = reasons[e] == LOOSELY or parser.elements[e] == "form"
            gone[e] = not (holds[e] and 2 * mass[e] >= mass[n] or loose and 10 * free <= mass[e] or reasons[e] == BY_CLASS and not free)
    return [element >= 0 and gone[element] for _, _, element in parser.lines]


def cluster(lines: list[tuple[str, int, int]], dropped: list[bool], sigma: float = 1.0) -> tuple[list[int], list[int]]:
    """Numbers of the lines whose smoothed text-to-tag ratio is at least one standard deviation; and of those among them whose own ratio is."""
    own = [0.0 if d else len(text) / max(1, tags) for (text, tags, _), d in zip(lines, dropped, strict=True)]
    ratios = smooth(own, sigma)
    mean = sum(ratios) / len(ratios)
    limit = math.sqrt(sum((x - mean) ** 2 for x in ratios) / len(ratios))
    kept = [i for i, x in enumerate(ratios) if x >= limit and not dropped[i]] or [i for i, d in enumerate(dropped) if not d]
    return kept, [i for i in kept if own[i] >= limit] or kept


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.read(html)
    lines, dropped = parser.lines, left_out(parser)
    if all(dropped):
        return ""
    found, strong = cluster(lines, dropped)
    counted = [0.0] * len(lines)
    for i in found:
        counted[i] = float(len(lines[i][0]))
    mass = sums(parser, counted)
    total = mass.pop()
    named = [e for tag in ("article", "main") for e in (max((e for e, m in enumerate(mass) if m and parser.elements[e] == tag), key=lambda e: (mass[e], -e), default=-1),) if e >= 0 and 2 * mass[e] >= total]
    region = named[0] if named else max((e for e, m in enumerate(mass) if m >= 0.9 * total and parser.elements[e] in FENCES), default=-1)
    if region < 0 or parser.elements[region] == "body":
        first = strong[0]
        first -= first > 0 and lines[first - 1][2] >= 0 and parser.elements[lines[first - 1][2]] in HEADINGS
        return " ".join(text for (text, _, _), gone in zip(lines[first : strong[-1] + 1], dropped[first : strong[-1] + 1], strict=True) if not gone)
    inside = [False] * len(mass)
    for e in range(region, len(mass)):
        inside[e] = e == region or (parser.parents[e] >= 0 and inside[parser.parents[e]])
    return " ".join(text for (text, _, element), gone in zip(lines, dropped, strict=True) if not gone and element >= 0 and inside[element])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
