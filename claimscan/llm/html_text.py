"""Main text of web pages: text-to-tag ratio per line over the events of the standard library's parser.

Start, end and text events are turned into lines, one per block of the page. Every line has a text-to-tag ratio. What
the contract names by element (menus, headers, footers, sidebars, forms, scripts, styles) or what a class calls by its full name an
advert, a notice or comments is no text and counts as a line of ratio 0; class names that only hint at page
furniture make a line weigh less. Inside an article names mean less: a quotation, heading or paragraph is text whatever its name, and a
block named a header, footer, notice or promotion is text where it has a sentence. The ratios are smoothed with a Gaussian over neighbouring lines, and lines whose smoothed
ratio reaches a share of the ratios' standard deviation cluster as content. The content's letters choose the regions (an
article or main element, else the containing block): those with a share of what the richest has. An article's region is
taken whole, lists of links (references) included, but for hinted lines that are no content; elsewhere from the first to the last
content line, without links.

Cases: a null or empty page has an empty text; an unclosed or stray tag ends with its parent or is
ignored; an unclosed comment hides the rest of the page; repeated rows are extracted each; an empty table gives an empty result. Further columns are
ignored, also such that bear the name of a result column.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import chunks
from ._work import in_arrow

SIGMA = 1.0
#: Content lines have a smoothed ratio of at least so many standard deviations of the page's ratios.
CUT = 0.5
#: A region is chosen if its content lines have at least this share of the letters of the richest one's.
SHARE = 0.25
#: What the ratio of a line counts whose class only hints at page furniture; the share of link text in a line of links.
HINTED, LINKS = 0.2, 0.9
#: What it counts inside an article if a name says "header" or "notice"; a line of at least so many words is a sentence.
NAMED_INSIDE, SENTENCE = 0.5, 6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template title nav header footer aside form button select textarea option svg math iframe object canvas audio video menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
REGIONS = frozenset("article main".split())
#: Words of a class, id or role that name what is no text, words that hint at it, and words for containers and for the text itself.
NAMED = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promoted cookie cookies consent gdpr notice notices disclaimer alert comment comments commentlist disqus respond reply replies sidebar nav navbar navigation menu breadcrumb breadcrumbs masthead contentinfo complementary newsletter header footer".split())
HINTS = frozenset("banner side rail share sharing social related recommended recommendations subscribe subscription signup popup modal overlay widget pagination pager toolbar search login skip hidden teaser".split())
PLAIN = frozenset("area bar block box buttons button container content items item inner left right top bottom links link list module panel section site slot thread unit wrapper wrap wide small large first last main page posts post the".split())
TEXT = frozenset("article body content entry main post story text".split())
#: Inside an article these names only weigh, and no name deletes an element of these kinds.
WEIGHS_INSIDE = frozenset("header footer masthead contentinfo notice notices disclaimer alert promo sponsor sponsors".split())
OWN_TEXT = frozenset("blockquote p pre q h1 h2 h3 h4 h5 h6 figure figcaption dd dt code em strong b i cite mark".split())
#: An outermost article or main element is skipped for these words only.
NOT_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related teaser".split())
#: Such parts of a class say what stands beside the content, not what it is.
BESIDE = re.compile(r"\b(?:with|has|no|without)[-_][\w-]+", re.IGNORECASE)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article-?body|articlebody|main|main-content|post-content|entry-content|article-content|story-body)(?:$|\s)", re.IGNORECASE)
SIZE = re.compile(r"\d+(?:x\d+)?")


def furniture(value: str, outermost: bool = False, inside: bool = False) -> float:
    """2 if a class, id or role names what is no text, 1 if it hints at it, else 0. Each name counts as a whole: "share-price" is neither.

    Inside an article 1.5 for names that only weigh there.
    """
    found = 0.0
    for name in BESIDE.sub("", value).lower().split():
        parts = [x for x in re.split(r"[-_]+", name) if x and not SIZE.fullmatch(x)]
        named, hinted = [x for x in parts if x in NAMED], [x for x in parts if x in HINTS]
        if outermost:
            found = max(found, 2 * any(x in NOT_ARTICLE for x in parts))
        elif (named or hinted) and all(x in NAMED or x in HINTS or x in PLAIN or x in TEXT for x in parts):
            head = set(named) <= {"header", "footer", "nav", "navigation", "menu"} and any(x in TEXT for x in parts)  # as in "entry-header"
            weighs = inside and set(named) <= WEIGHS_INSIDE and not hinted
            found = max(found, 0 if head and not hinted else 1.5 if named and weighs else 2 if named else 1)
    return found


class Lines(HTMLParser):
    """Collects a page's lines: text, number of tags, region (0: none; -1: skipped), container, weight, and letters in links."""

    def __init__(self, use_marks: bool = True):
        super().__init__(convert_charrefs=True)
        self.use_marks = use_marks
        self.open: list[tuple[str, int, int, float, bool]] = []  # tag, region, container, weight, inside a link
        # places of the blocks among them, and how many there are of each tag: so no search passes over elements that stay open
        self.blocks: list[int] = []
        self.counts: Counter[str] = Counter()
        self.n = 0
        self.lines: list[tuple[str, int, int, int, float, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.hidden = False
        self.place = (0, 0, 1.0)

    def _end_line(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            if words:
                self.lines.append((words, self.tags, *self.place, self.linked))
                self.tags = 0
            self.text.clear()
        elif self.hidden:
            self.lines.append(("", self.tags, -1, 0, 0.0, 0))
            self.tags = 0
        self.hidden, self.linked = False, 0

    def _move(self) -> None:
        self.place = self.open[-1][1:4] if self.open else (0, 0, 1.0)

    def _close_from(self, i: int) -> None:
        while len(self.open) > i:
            self.counts[self.open.pop()[0]] -= 1
        while self.blocks and self.blocks[-1] >= i:
            self.blocks.pop()

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS or (tag in SKIPPED and tag != "title"):
            self._end_line()
        elif tag in ("br", "td", "th", "img"):
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in BLOCKS and self.blocks and self.open[self.blocks[-1]][0] == "p":  # a block ends an open paragraph
            self._close_from(self.blocks[-1])
        region, container, weight = self.open[-1][1:4] if self.open else (0, 0, 1.0)
        if region >= 0:
            names = [v for k, v in attrs if v and k in ("class", "id", "role", "itemprop")] if self.use_marks and tag not in ("html", "body") else []
            text = any(ARTICLE.search(v) for v in names)
            mark = 0 if text else max((furniture(v, tag in REGIONS and not region, region > 0) for v in names), default=0)
            if region and mark > 1 and tag in OWN_TEXT:
                mark = 0
            unseen = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "").lower()) for k, v in attrs)
            if tag in SKIPPED or unseen or mark == 2:
                region = -1
            elif not region and (tag in REGIONS or text):
                self.n += 1
                region = self.n
            weight = min(weight, {1: HINTED, 1.5: NAMED_INSIDE}.get(mark, 1.0))
            if tag in ("div", "section", "td", "body", "article", "main") and region >= 0:
                self.n += 1
                container = self.n
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.counts[tag] += 1
        self.open.append((tag, region, container, weight, tag == "a" or bool(self.open) and self.open[-1][4]))
        if (region, container, weight) != self.place:
            self._end_line()
            self._move()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS or tag in SKIPPED:
            self._end_line()
        if not self.counts[tag]:
            return
        i = len(self.open) - 1
        while self.open[i][0] != tag:
            i -= 1
        if self.open[i][1:4] != (self.open[i - 1][1:4] if i else (0, 0, 1.0)):
            self._end_line()
        self._close_from(i)
        self._move()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.place[0] >= 0:
            self.text.append(data)
            if self.open and self.open[-1][4]:
                self.linked += len("".join(data.split()))
        elif not self.hidden and not data.isspace():
            self.hidden = True

    def finish(self) -> list[tuple[str, int, int, int, float, int]]:
        self.close()
        self._end_line()
        return self.lines


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def choose(lines: list[tuple], use_ratio: bool = True) -> np.ndarray:
    """Which lines are the main text. Without the ratio: every line that is not skipped."""
    region, container = (np.array([x[i] for x in lines]) for i in (2, 3))
    letters = np.array([len(x[0]) for x in lines])
    weight = np.array([x[4] for x in lines])
    seen = region >= 0
    if not use_ratio:
        return seen
    ratio = weight * letters / np.maximum(1, [x[1] for x in lines])
    smoothed = smooth(ratio)
    cut = min(CUT * ratio.std(), smoothed[seen].max())
    content = seen & (smoothed >= cut) & ((weight == 1) | (ratio >= cut))  # a hinted line has to be content by itself
    links = np.array([x[5] for x in lines]) >= LINKS * np.maximum(1, [len("".join(x[0].split())) for x in lines])
    edges = np.flatnonzero(np.diff(links, prepend=False, append=False))
    for a, b in edges.reshape(-1, 2):  # a run of links is content if most of it is
        content[a:b] &= content[a:b].mean() > 0.5
    inside = content & (region > 0)
    group = region if inside.any() else container
    content = inside if inside.any() else content
    mass = np.bincount(group[content], weights=letters[content], minlength=max(group.max(), 0) + 1)
    chosen = mass >= max(1, SHARE * mass.max())
    if inside.any():
        keep = (region > 0) & chosen[np.maximum(region, 0)]
    else:  # from each chosen container's first to its last content line
        own = np.flatnonzero(content & chosen[np.maximum(container, 0)])
        first, last = np.full(len(mass), len(lines)), np.full(len(mass), -1)
        np.minimum.at(first, container[own], own)
        np.maximum.at(last, container[own], own)
        spans = np.zeros(len(lines) + 1, dtype=np.int64)
        np.add.at(spans, first[last >= 0], 1)
        np.add.at(spans, last[last >= 0] + 1, -1)
        keep = np.cumsum(spans)[:-1] > 0
    sentence = np.array([x[0].count(" ") + 1 >= SENTENCE for x in lines])
    return keep & seen & (content | ((weight == 1) & (~links | (region > 0))) | ((weight == NAMED_INSIDE) & sentence & ~links))


def main_text(html: str | None, use_ratio: bool = True) -> str:
    html = html or ""
    last = html.rfind("<!--")  # an unclosed comment hides the rest
    if last >= 0 and html.find("-->", last) < 0 and html.lower().find("</script", last) < 0:
        html = html[:last]
    lines: list[tuple] = []
    for use_marks in (True, False):  # if class names would leave nothing, only the elements' kinds decide
        if not any(x[0] for x in lines):
            parser = Lines(use_marks)
            parser.feed(html)
            lines = parser.finish()
    if not any(x[0] for x in lines):
        return ""
    return "\n".join(x[0] for x, k in zip(lines, choose(lines, use_ratio), strict=True) if k)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "html", 8 << 20):
                texts = [main_text(x) for x in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).alias("html"))
    return in_arrow(rows, run, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
