"""Main text of web pages by the text-to-tag ratio of their lines.

A streaming parser turns a page into lines: one for each run of text between block-level tags,
with the number of tags inside, and the container (article, main, section, div, ...) that it
stands in. What cannot be main text by its tag or by a whole class, id or role is left out,
unless it holds half or more of the text that stands in articles (or, on a page without them, of
all text). Reader comments are left out whatever their length, also as articles of their own; only
if nothing but menu items stands outside, their name is taken for a wrong one. The logarithm of the ratio of letters to tags of each line, so that a long line does
not decide alone, is smoothed over its neighbours with a Gaussian kernel, and lines above a
threshold (the mean of the two centres that a two-means clustering of the smoothed values finds)
are content. The region is the innermost container that covers nearly all content, or several
articles together; all of its lines in page order are the text, so a short paragraph between
long ones stays. Headings and sections inside the region are not left out for their id, which is
often made from a heading, nor for a class that may be a subject (`discussion`, `related`) if
sentences make up most of them.

Defined results: null, empty and tag-only pages have the empty text and 0 characters; character
references are decoded; unclosed and stray tags are tolerated; text outside of any container
belongs to the page. Rows are independent, so repeated rows give equal results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.llm.common import as_texts, slices

# HTML elements by their part in a page.
NO_TEXT = set(
    "head title script style noscript template button select textarea input label option iframe "
    "object svg canvas menu audio video map".split()
)
ASIDE = set("nav footer aside form dialog".split())  # and header, outside of articles
CONTAINERS = set("html body main article section div td blockquote figure".split())
REGIONS = set("html body main article section div".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCKS = CONTAINERS | HEADINGS | set(
    "address caption center col colgroup dd details dl dt fieldset figcaption "
    "header hgroup hr legend li ol p pre search summary table tbody tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Whole classes, ids and roles that mark what is not main text: a word of the first group, also
# as the last part of a name (site-footer), perhaps with a word for a place or box after it
# (share-buttons), or one that says nothing as part of a longer name.
OTHER = re.compile(
    r"(?:(?!(?:has|is|no|not|with|without|hide|show)[-_])[a-z0-9]+[-_]+)*"
    r"(?:ads?|adv|advert\w*|sponsor(?:ed|s)?|promo(?:s|tion|tions)?|banner|nav|navbar|navigation|"
    r"menus?|breadcrumbs?|masthead|footer|copyright|sidebar|widgets?|related|recommended|"
    r"recommendations|cookies?|consent|gdpr|notice|notices|notification|popup|modal|overlay|"
    r"subscribe|newsletter|signup|login|comments?|commentlist|disqus|replies|respond|share|sharing|"
    r"social|pagination|pager|toolbar|form)"
    r"(?:[-_]+(?:area|bar|block|box|button|buttons|column|container|group|icons|inner|item|items|"
    r"left|links?|list|panel|posts|articles|stories|right|section|slot|unit|wrap|wrapper))*[-_]*\d*"
    r"|(?:site|global|top)[-_]?header|header|foot|side|side[-_]?bar|aside|discussion|alert|subscription|"
    r"reply|tags?|search|skip|skip-link|complementary|contentinfo",
    re.IGNORECASE,
)
# Whole names of reader comments.
COMMENTS = re.compile(
    r"(?:(?!(?:has|is|no|not|with|without|hide|show)[-_])[a-z0-9]+[-_]+)*"
    r"(?:comments?|commentlist|disqus|replies|respond)"
    r"(?:[-_]+(?:area|author|block|body|box|bubble|column|container|content|count|entry|footer|form|group|inner|"
    r"items?|list|meta|panel|section|slot|text|thread|threads|wrap|wrapper))*[-_]*\d*",
    re.IGNORECASE,
)
# Names that are subjects as often as parts of a page, if a section of sentences has them.
SUBJECT = re.compile(
    r"related|related[-_]work|discussion|search|recommended|recommendations|form|social|consent|navigation|"
    r"notification|alert|copyright|reply|header|foot",
    re.IGNORECASE,
)
ENDING = BLOCKS | NO_TEXT | ASIDE  # their end tags close what is open inside
NEARLY_ALL = 0.9  # of the content, which a region covers
SENTENCE = 80  # letters a tag that make a line content on any page
DENSE = 40  # letters a tag of the lines that are sentences rather than links
POST = 25  # letters of a line that is no menu item
SIGMA = 1.0
SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Collects (text, tags, number of the innermost node) for every line. Nodes are containers
    and marked elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.open: list[tuple[str, bool, int]] = []  # tag, left out, node number or -1
        self.left_out = 0
        self.path: list[int] = [0]
        self.names = ["html"]
        self.parents = [-1]  # of nodes, which have higher numbers than their parents
        # "tag", "comments", "name" (class or role), "subject" (such a class of a heading or
        # section), "id" (of a heading or section), or none
        self.marks = [""]
        self.text: list[str] = []
        self.tags = 0

    def end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, self.path[-1]))
        self.text, self.tags = [], 0

    def _mark(self, tag, attrs) -> str:
        if tag in ASIDE or (tag == "header" and not self._in_article()):
            return "tag"
        if tag in ("html", "body", "main"):
            return ""
        values = {k: v.split() for k, v in attrs if v and k in ("class", "id", "role")}
        if tag not in HEADINGS and any(COMMENTS.fullmatch(v) for names in values.values() for v in names):
            return "comments"
        if tag == "article":
            return ""
        section = tag in HEADINGS or tag == "section" or "section" in values.get("class", ())
        found = [v for k in ("class", "role") for v in values.get(k, ()) if OTHER.fullmatch(v)]
        if found:
            return "subject" if section and all(SUBJECT.fullmatch(v) for v in found) else "name"
        if any(OTHER.fullmatch(v) for v in values.get("id", ())):
            return "id" if section else "name"
        return ""

    def handle_starttag(self, tag, attrs):
        out = tag in NO_TEXT
        mark = "" if out or self.left_out else self._mark(tag, attrs)
        if (out or mark) and not self.left_out:
            self.end_line()
        if tag in BLOCKS:
            if not self.left_out:
                self.end_line()
        elif tag == "br":
            self.text.append(" ")
        if not self.left_out and not out:
            self.tags += 1
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            self._close_implied(tag)
        number = -1
        if mark or (tag in CONTAINERS and not out and not self.left_out):
            number = len(self.names)
            self.names.append(tag)
            self.parents.append(self.path[-1])
            self.marks.append(mark)
            self.path.append(number)
        self.open.append((tag, out, number))
        self.left_out += out

    def _in_article(self) -> bool:
        return any(tag == "article" for tag, _, _ in self.open)

    def _close_implied(self, tag: str) -> None:
        """A new paragraph, item or cell ends an open one of its kind and container."""
        for nth in range(len(self.open) - 1, -1, -1):
            name = self.open[nth][0]
            if name == tag:
                self._close_to(nth)
                return
            if name in ("ul", "ol", "dl", "table") or name in CONTAINERS:
                return

    def _close_to(self, nth: int) -> None:
        if not self.left_out and any(n >= 0 and self.marks[n] for _, _, n in self.open[nth:]):
            self.end_line()
        for _, out, number in reversed(self.open[nth:]):
            self.left_out -= out
            if number >= 0:
                self.path.pop()
        del self.open[nth:]

    def handle_endtag(self, tag):
        if tag in BLOCKS and not self.left_out:
            self.end_line()
        for nth in range(len(self.open) - 1, -1, -1):
            if self.open[nth][0] == tag:
                if tag in ENDING or all(name not in ENDING for name, _, _ in self.open[nth:]):
                    if self.open[nth][1] or any(out for _, out, _ in self.open[nth:]):
                        self.text, self.tags = [], 0
                    self._close_to(nth)
                break

    def handle_data(self, data):
        if not self.left_out:
            self.text.append(data)


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for k, w in zip(range(i - reach, i + reach + 1), kernel):
            if 0 <= k < len(ratios):
                total += w * ratios[k]
                weight += w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Middle of the centres of a two-means clustering."""
    low, high = min(values), max(values)
    for _ in range(20):
        middle = (low + high) / 2
        above = [v for v in values if v > middle]
        below = [v for v in values if v <= middle]
        if not above or not below:
            break
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _summed(values: list[int], parents: list[int]) -> list[int]:
    """With those of inner nodes."""
    values = list(values)
    for number in range(len(values) - 1, 0, -1):
        values[parents[number]] += values[number]
    return values


def _below(wanted: list[bool], parents: list[int]) -> list[bool]:
    """Nodes that are wanted or stand in one."""
    out: list[bool] = []
    for number, parent in enumerate(parents):
        out.append(wanted[number] or (parent >= 0 and out[parent]))
    return out


def _left_out(parser: Lines) -> list[str]:
    """The marks of nodes that do not hold the main text.

    Reader comments never do, however long they are, unless nothing but menu items stands
    outside of what such a name marks."""
    names, parents = parser.names, parser.parents
    comments = _below([mark == "comments" for mark in parser.marks], parents)
    marked = _below([bool(mark) for mark in parser.marks], parents)
    is_article = [name in ("article", "main") for name in names]
    in_article = _below(is_article, parents)
    if not any(
        not comments[k] and (in_article[k] or (not marked[k] and len(text) >= POST)) for text, _, k in parser.lines
    ):
        comments = [False] * len(names)
    letters, plain = [0] * len(names), 0
    inner = _summed([int(i and not c) for i, c in zip(is_article, comments)], parents)
    aside = _below([mark == "tag" and not inner[k] for k, mark in enumerate(parser.marks)], parents)
    for text, _, number in parser.lines:
        if not comments[number]:
            letters[number] += len(text)
            plain += 0 if aside[number] else len(text)
    text, whole = letters, True
    for kinds in (("article",), ("article", "main")):
        inside = _below([name in kinds for name in names], parents)
        some = [n if i else 0 for n, i in zip(letters, inside)]
        if sum(some) and 4 * sum(some) >= plain:  # fewer letters are teasers
            text, whole = some, False
            break
    held = _summed(text, parents)
    articles = inner
    marks = []
    for k, mark in enumerate(parser.marks):
        if mark and comments[k]:
            marks.append("comments")
            continue
        most = held[0] and 2 * held[k] >= held[0]
        # Forms may be wrapped around a page; other tags hold the text only with an article.
        kept = most and (articles[k] or (whole and (mark != "tag" or parser.names[k] == "form")))
        marks.append("" if kept else mark)
    return marks


def _region(parser: Lines, lines: list[tuple[str, int, int]], sigma: float) -> list[bool]:
    """Whether a node is in the region that covers nearly all content."""
    names, parents = parser.names, parser.parents
    ratios = smoothed([math.log1p(len(text) / max(1, tags)) for text, tags, _ in lines], sigma)
    limit = min(threshold(ratios), math.log1p(SENTENCE))
    count, mass = [0] * len(names), [0] * len(names)
    for (text, _, number), ratio in zip(lines, ratios):
        if ratio >= limit:
            count[number] += 1
            mass[number] += len(text)
    is_article = [name in ("article", "main") for name in names]
    inside = _below(is_article, parents)
    if 2 * sum(m for m, i in zip(mass, inside) if i) >= sum(mass):
        count = [n if i else 0 for n, i in zip(count, inside)]
        mass = [m if i else 0 for m, i in zip(mass, inside)]
        candidates = is_article
    else:
        candidates = [name in REGIONS for name in names]
    count, mass = _summed(count, parents), _summed(mass, parents)
    covering = [
        k for k, fits in enumerate(candidates)
        if fits and count[k] >= NEARLY_ALL * count[0] and mass[k] >= NEARLY_ALL * mass[0]
    ]
    if covering:
        wanted = [k == covering[-1] for k in range(len(names))]
    else:  # several articles
        wanted = [fits and count[k] > 0 for k, fits in enumerate(candidates)]
    return _below(wanted, parents)


def main_text(html: str, sigma: float = SIGMA) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    marks = _left_out(parser)
    out = _below([bool(mark) for mark in marks], parser.parents)
    lines = [line for line in parser.lines if not out[line[2]]]
    if not lines:
        return ""
    inside = _region(parser, lines, sigma)
    every, dense = [0] * len(marks), [0] * len(marks)
    for text, tags, number in parser.lines:
        every[number] += len(text)
        dense[number] += len(text) if len(text) >= DENSE * max(1, tags) else 0
    every, dense = _summed(every, parser.parents), _summed(dense, parser.parents)
    is_out = [
        mark in ("tag", "name", "comments") or (mark == "subject" and 2 * dense[k] < every[k] and parser.names[k] not in HEADINGS)
        for k, mark in enumerate(marks)
    ]
    out = _below(is_out, parser.parents)
    return "\n\n".join(text for text, _, number in parser.lines if inside[number] and not out[number])


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Every row: page_id, url, text, n_chars."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{html_col}`").cast("string").alias("html"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text="html"):
            texts = [main_text(h) for h in as_texts(part, "html")]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
