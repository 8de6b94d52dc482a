"""Main text of web pages by text-to-tag ratios.

The standard library's parser is fed the page; its events give lines, one for each block
element's own text. Each line has a text-to-tag ratio; the ratios are smoothed with a Gaussian
and lines at or above the threshold (the standard deviation of the ratios) form the content
regions. The article is the element that holds those regions, with every line in it:
short paragraphs between long ones belong to it whatever their ratio. Lines of elements whose
tag, role or class says menu, header, footer, sidebar, notice, advert, form or comments never count:
ratios alone can't tell a footer of a sentence from a paragraph of a word.

A null or empty page, and one without any such line, gives the empty text. Rows are worked on
each by itself, whole, in time that grows with the page however deep it is nested; repeated rows
give repeated results, an empty table an empty one. Of equal ratios all are chosen or none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import slices, struct_array, struct_type, table, utf8

# Element names of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NOT_TEXT = frozenset(
    "aside audio button canvas dialog embed fieldset footer form head header iframe input math menu nav noscript object option "
    "script select style svg template textarea title video".split()
)
ARTICLE = frozenset(("article", "main"))
#: A start tag of the key ends an open element of the values, if one is open nearer than a container.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th"),
}
#: Elements that a p does not outlive.
ENDS_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr main menu nav ol p pre section table ul".split()
)
HOLDS = frozenset("article aside body blockquote div dl figure footer form header html main menu nav ol section table td th ul".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that mark what is not the article.
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright dfp disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pagination pager "
    "paywall popup promo promos promoted promotion related recommended remark replies reply responses search share sharing sidebar sidebars signup skip social "
    "sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget widgets".split()
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
SPACE = re.compile(r"\s+")
SIGMA, REACH = 1.0, 2
#: Elements that hold a paragraph's own text are no articles.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li td tr".split())


def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in NOT_TEXT:
        return True
    if tag in ("html", "body"):
        return False
    for name, value in attrs:
        if name == "hidden":
            return True
        if not value:
            continue
        if name in ("class", "id"):
            words = [w.lower() for w in WORDS.findall(value)]
            if any(w in MARKS for w in words) and not (tag in ARTICLE and not {"comment", "comments", "reply", "ad", "promo", "related"} & set(words)):
                return True
        elif name == "role":
            if value.strip().lower() in ROLES:
                return True
        elif name == "aria-hidden":
            if value.strip().lower() == "true":
                return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Lines(HTMLParser):
    """Lines of (text, tags, characters in links, number of the element); elements by number, in the order of their starts: (tag, parent), and the number after their last descendant's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, int]] = [("", -1)]
        self.ends: list[int] = [0]
        self.opened: Counter = Counter()  # tags that are open
        self.blocks = [0]  # numbers of the open block elements
        self.open: list[tuple[str, int, bool]] = []  # tag, number, marked
        self.marked = self.links = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.at = 0

    def _number(self) -> int:
        return self.open[-1][1] if self.open else 0

    def flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, self.tags, self.linked, self.at))
            self.parts = []
        self.tags = self.linked = 0

    def _pop(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, number, marked = self.open.pop()
            self.ends[number] = len(self.elements)
            self.opened[tag] -= 1
            self.marked -= marked
            self.links -= tag == "a"
            if tag in BLOCK:
                self.flush()
                self.blocks.pop()

    def _implied(self, tag: str) -> None:
        """Ends that a start tag implies."""
        names = ENDS.get(tag, ())
        if not any(self.opened[x] for x in names) and not (self.opened["p"] and tag in ENDS_P):
            return None
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name in names:
                if name in ("tr", "td", "th") and tag != name and tag in ("tbody", "thead", "tfoot", "tr") and any(x[0] in names for x in self.open[max(0, k - 2) : k]):
                    continue
                return self._pop(k)
            if name == "p" and tag in ENDS_P:
                return self._pop(k)
            if name in HOLDS or name == "button":
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in ENDS or tag in ENDS_P:
            self._implied(tag)
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        self.elements.append((tag, self._number()))
        self.ends.append(0)
        marked = _marked(tag, attrs)
        self.open.append((tag, len(self.elements) - 1, marked))
        self.opened[tag] += 1
        if tag in BLOCK:
            self.blocks.append(len(self.elements) - 1)
        self.marked += marked
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        for k in range(len(self.open) - 1, -1, -1) if self.opened[tag] else ():
            name = self.open[k][0]
            if name == tag:
                return self._pop(k)
            if tag not in BLOCK and name in HOLDS:
                return None
        if tag == "p":  # an end of nothing is an empty p
            self.flush()
        return None

    def handle_data(self, data):
        if self.marked or not data:
            return
        if not self.parts:
            if data.isspace():
                return
            self.at = self.blocks[-1]
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def _smoothed(ratios: list[float]) -> list[float]:
    weights = [math.exp(-k * k / (2 * SIGMA * SIGMA)) for k in range(-REACH, REACH + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(w, ratios[i + k]) for w, k in zip(weights, range(-REACH, REACH + 1)) if 0 <= i + k < len(ratios)]
        out.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return out


def main_text(html: str) -> str:
    """Blocks of the page's article, joined by newlines."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._pop(0)
    parser.flush()
    parser.ends[0] = len(parser.elements)
    lines = parser.lines
    if not lines:
        return ""
    ratios = [len(text) / max(1, tags) for text, tags, _, _ in lines]
    mean = sum(ratios) / len(ratios)
    level = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    smooth = _smoothed(ratios)
    level = min(level, max(smooth))
    chosen = [i for i, s in enumerate(smooth) if s >= level]
    weight = [0] * len(parser.elements)  # of the chosen lines of an element and of all within
    for i in chosen:
        text, _, linked, at = lines[i]
        weight[at] += max(1, len(text) - linked)
    for k in range(len(weight) - 1, 0, -1):
        weight[parser.elements[k][1]] += weight[k]
    holders = [k for k in range(len(weight)) if weight[k] == weight[0] and parser.elements[k][0] not in PARTS]
    root = k = holders[-1]  # the lowest that holds all chosen lines, unless that stands in an article
    while k >= 0:
        if parser.elements[k][0] in ARTICLE:
            root = k
        k = parser.elements[k][1]
    return "\n".join(text for text, _, _, at in lines if root <= at < parser.ends[root])


@F.arrow_udf(struct_type(text=T.StringType(), n_chars=T.LongType()))
def _extracted(pages: pa.Array) -> pa.Array:
    texts = [main_text(b.decode("utf-8", "replace")) for part in slices(pages) for b in part]
    return struct_array(["text", "n_chars"], [texts, [len(t) for t in texts]], [pa.string(), pa.int64()])


def extract(pages: DataFrame, html: str = "html", out: str = "main") -> DataFrame:
    """The rows with a column ``out`` of (text, n_chars); one of that name is replaced, others stay."""
    return pages.withColumn(out, _extracted(utf8(html)))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "main.*")


QUERIES = {"op9_html_text": op9_html_text}
SQL: dict[str, str] = {}
