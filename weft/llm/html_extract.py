"""HTML main text: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser is fed a page and its events are folded into lines, one per
block. A line's ratio is its characters by its tags; the ratios are smoothed with a Gaussian
over neighbouring lines. Where an element's tag, class, id or role speaks against article text
(menus, headers, footers, asides, forms, adverts, comments), and where a page marks its
articles and a line is in none, the smoothed ratio is lowered by a factor. Lines of one
container that are lowered alike form a region, an article is one however it is divided, and a
region's value is the mean of its lines' ratios by characters. A threshold parts the regions in
two clusters: the lines' standard deviation, or a share of the best region's value if that is
more, lowered to the best value when none reaches it. All lines of the upper regions are the
text. Names never decide alone: a lowered region whose ratio is high enough still is content.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import map_batches, slices

BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a browser shows no text of.
UNSEEN = frozenset("head script style noscript template iframe object svg canvas audio video title".split())
#: What seldom is article text.
SELDOM = frozenset("nav header footer aside form menu button select textarea input label dialog".split())
#: A paragraph ends where one of these begins, even if its end tag is missing; likewise list items, cells and options.
ENDS_P = BLOCKS - {"br", "body", "html", "head", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "caption", "title"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("article aside body div dl footer form header html main nav ol section table ul".split())
CONTAINERS = frozenset("article main section div td body html blockquote".split())
NAMED = re.compile(r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|footer|sidebar|aside|ads?|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended|comments?|commentlist|disqus|replies|reply|respond|toolbar|pagination|pager|widget|copyright)(?:$|[-_\s])", re.I)
#: Words that name a layout as often as a part of it: an article inside such an element is still one.
LAYOUT = re.compile(r"(?:^|[-_\s])(?:nav|navbar|menu|header|masthead|footer|sidebar|aside|banner|search|share|social)(?=$|[-_\s])", re.I)
#: What a class says that something has or lacks.
HAS = re.compile(r"(?:^|(?<=\s))(?:no|has|with|without)[-_]\S*", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())


@dataclass(frozen=True)
class Ratios:
    #: Width of the Gaussian, in lines.
    sigma: float = 0.7
    #: Factor on a ratio that a name lowers; once more where a page marks articles and the line is in none.
    lowered: float = 0.02
    #: Least share of the best region's value.
    share: float = 0.3
    #: Least value of a region that is lowered, in characters by tag.
    floor: float = 4.0


class Lines(HTMLParser):
    """Events to lines: (text pieces, tags, container number, lowered, in an article). Lowered: 1 by a word of layout, 2 by others, 3 if not shown at all."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, int]] = []  # tag, lowered, in an article, container
        self.lines: list[tuple[list[str], int, int, int, bool]] = []
        self.text: list[str] = []
        self.tags = 0
        self.containers = 0

    def _state(self) -> tuple[int, bool, int]:
        return self.open[-1][1:] if self.open else (0, False, 0)

    def _close_line(self) -> None:
        if self.text or self.tags:
            low, article, container = self._state()
            self.lines.append((self.text, self.tags, container, low, article))
            self.text, self.tags = [], 0

    def _pop(self, at: int) -> None:
        del self.open[at:]

    def _end_open(self, tags: tuple[str, ...]) -> None:
        """Close the nearest of these, unless a container stands between."""
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name in tags:
                self._close_line()
                self._pop(at)
                return
            if name in SCOPES:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end_open(("p",))
        if tag in SIBLINGS:
            self._end_open(SIBLINGS[tag])
        if tag in BLOCKS:
            self._close_line()
        self.tags += 1
        if tag in VOID:
            if tag in BLOCKS:
                self._close_line()
            return
        low, article, container = self._state()
        inside = article
        article = article or tag in ("article", "main")
        if low == 1 and tag in ("article", "main"):
            low = 0
        if tag in UNSEEN:
            low = 3
        if not low:
            low = 2 * (tag in SELDOM and not (tag == "header" and article))
            for name, value in attrs:
                value = value or ""
                if low == 2:
                    break
                if name in ("class", "id"):
                    words = HAS.sub(" ", value)
                    if tag in ("body", "html", "main") or not NAMED.search(words):
                        continue
                    layout = not NAMED.search(LAYOUT.sub(" ", words))
                    # an article's own header has its title; an article is not made a sidebar by a word
                    if not layout or not (tag == "article" or (inside and "header" in words.lower())):
                        low = max(low, 1 if layout else 2)
                elif (name == "role" and value.strip().lower() in ROLES) or name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                    low = 2
        if tag in CONTAINERS and not inside:  # an article is one region, however it is divided
            self.containers += 1
            container = self.containers
        self.open.append((tag, low, article and not low, container))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._close_line()
        self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._pop(at)
                return
            if self.open[at][0] in SCOPES and tag not in SCOPES:
                return

    def handle_data(self, data):
        self.text.append(data)

    def finish(self) -> list[tuple[str, int, int, bool, bool]]:
        self.close()
        self._close_line()
        return [(" ".join("".join(text).split()), tags, container, low, article) for text, tags, container, low, article in self.lines]


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian average over neighbours; at the ends over those that there are."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    whole = np.convolve(x, kernel)[reach : reach + len(x)]
    return whole / np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]


def main_text(html: str, how: Ratios = Ratios()) -> str:
    page = Lines()
    page.feed(html)
    # a line with text opens; tags of lines without text count for the next one
    rows: list[tuple[str, int, int, int, bool]] = []
    tags = 0
    for text, own, container, low, article in page.finish():
        tags += own
        if text and low < 3:
            rows.append((text, tags, container, low, article))
            tags = 0
    if not rows:
        return ""
    marked = any(article for *_, article in rows)
    weights = np.array([how.lowered ** ((low > 0) + (marked and not article)) for *_, low, article in rows])
    sizes = np.array([len(r[0]) for r in rows], dtype=float)
    ratios = sizes / np.maximum(1, [r[1] for r in rows])
    # a lowered line gives its neighbours as little as it has itself, and is not lifted by them
    values = np.where(weights < 1, np.minimum(ratios, smooth(ratios, how.sigma)) * weights, smooth(ratios * weights, how.sigma))
    numbers: dict[tuple[int, float], int] = {}
    region = np.array([numbers.setdefault((r[2], w), len(numbers)) for r, w in zip(rows, weights.tolist(), strict=True)])
    of_region = np.bincount(region, weights=values * sizes) / np.bincount(region, weights=sizes)
    lowest = np.array([0.0 if w == 1 else how.floor for _, w in numbers])
    best = float(of_region.max())
    upper = (of_region >= min(best, max(float(values.std()), how.share * best))) & (of_region >= lowest)
    return " ".join(r[0] for r, fine in zip(rows, upper[region].tolist(), strict=True) if fine)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per row of ``pages``.

    A null or empty page, or one without content, has an empty text; null ids and urls stay null;
    repeated rows give repeated rows; an empty table gives none; other columns are not read. Each
    page is parsed where it is read; nothing is shuffled.
    """

    def run(batches):
        for part in slices(batches, 64):
            texts = [main_text(x) if x else "" for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    return map_batches(plain, run, "page_id long, url string, text string, n_chars long")
