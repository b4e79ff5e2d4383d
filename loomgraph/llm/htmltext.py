"""Main text of web pages by tag-path ratios.

Each page becomes a sequence of text blocks; inline elements belong to the block that they stand in. A block's tag path
names the elements from the root to it, with their classes. For every path, text length (links left out) and
punctuation are summed over its blocks and divided by their number. Both series are
smoothed over the page's block order and fused: length times one plus punctuation, less where a path leads through an element
that is labelled as something else than the article (menus, comments, adverts ...) or stands outside of the page's
article or main element. Paths whose fused ratio passes the threshold are content, and all of their blocks are kept.

Outside of the smallest element that holds nearly all of the content and its paths, where smoothing may lift what only stands next
to it, a path's own ratio must pass the threshold, too; headings and well-marked paragraphs right beside that element stay. Inside, short blocks (headings, captions, items of lists) stay as well,
but for labelled ones, lists of links, and classed or outlying containers with little text of their own.

Defined results: null and empty pages, and an empty table, give empty texts and an empty table; pages of any length and
depth are read whole, in time in proportion to their length; broken and unclosed markup is read as browsers
do in the common cases (an open paragraph ends where a block begins); repeated rows
give equal results; equal ratios are kept or left out together; other columns are passed over, and one named as
the result is an error.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.common import extended

#: Standard deviation, in blocks, of the smoothing window, and its half width.
SIGMA, REACH = 1.0, 2
#: Share of the best fused ratio that makes a path content.
THRESHOLD = 0.3
#: The same for a paragraph that stands beside the article's element, without regard to how much its path holds.
BESIDE = 0.1
#: Length and marks above which a block is text and not more so: a path of very long blocks does not outdo the others.
LENGTH, MARKS = 500.0, 8.0
#: What a label, or standing outside of the page's article, leaves of a fused ratio.
LABELLED, OUTSIDE = 0.1, 0.3
#: Share of the content's characters that the smallest element must hold, and of a path's that make it a list of links.
SHARE, LINKS = 0.9, 0.8

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSE_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "title", "legend"}
P_SCOPE = ("td", "th", "button", "table", "object")
#: An opening tag ends these open elements, up to the nearest of the scope.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}
#: Elements whose text is not shown, or is a control's.
HIDDEN = frozenset("head button select option input textarea script style noscript template iframe svg canvas object audio video title datalist".split())
#: Blocks that hold text in their own right; others are containers.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 hgroup p li dt dd td th caption figcaption blockquote pre address summary legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements, and words of class, id and role, that label what is not the article.
LABELS = frozenset("nav aside footer header menu form dialog".split())
LABEL_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar sidebars aside widget widgets "
    "comment comments reply replies respond disqus discussion notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations pagination pager toolbar search skip skiplink complementary contentinfo".split()
)

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_REST = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_SPACE = re.compile(r"\s+")
#: Marks at the end of a word, so those within host names and numbers don't count.
_PUNCTUATION = re.compile(r"[.,;:!?…](?=\s|$)|[、。，！？]")
_WORDS = re.compile(r"[a-z]+")


def _marked(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(label, labelled, hidden) of an element: its tag with its classes, whether it is labelled as no article, and whether it isn't shown."""
    label, labelled, hidden = tag, tag in LABELS, tag in HIDDEN
    if not attributes or hidden:
        return label, labelled, hidden
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name in ("class", "id", "role", "itemprop"):
            if name == "class":
                label = f"{tag}.{'.'.join(value.split())}"
            if tag not in ("html", "body", "main", "article"):
                words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())
                labelled = labelled or not LABEL_WORDS.isdisjoint(words)
    return label, labelled, hidden


@dataclass
class Block:
    """A stretch of text between the borders of block elements."""

    element: int  # the block element that holds it
    parts: list[str]
    linked: list[bool]
    text: str = ""
    length: int = 0
    free: int = 0  # characters outside of links
    marks: int = 0


class Page:
    """A page's elements (numbered from the root down) and text blocks, in page order.

    Of element e: parent[e], tag[e], path[e] (number of its tag path), labelled[e] (it or one around it is),
    last[e] (the last element within it), held[e] (it or one around it is an article or main element).
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.labelled, self.last, self.held, self.classed = [-1], [""], [0], [False], [0], [False], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []
        self._tags: list[str] = []  # open elements
        self._ids: list[int] = [0]
        self._home: list[int] = [0]  # the block element of each open element
        self._hidden: list[bool] = []
        self._at: dict[str, list[int]] = defaultdict(list)  # where each tag is open
        self._open_blocks: list[int] = []
        self._banned = self._links = 0
        self._new = True
        self._read(source)
        self._pop(0)
        for b in self.blocks:
            b.text = _SPACE.sub(" ", "".join(b.parts)).strip()
            b.length = len(b.text)
            b.free = b.length if not any(b.linked) else len(_SPACE.sub(" ", "".join(x for x, k in zip(b.parts, b.linked, strict=True) if not k)).strip())
            b.marks = len(_PUNCTUATION.findall(b.text))
            b.parts, b.linked = [], []
        self.blocks = [b for b in self.blocks if b.text]

    def _text(self, text: str) -> None:
        if text and not self._banned:
            if self._new:
                self.blocks.append(Block(self._home[-1], [], []))
                self._new = False
            self.blocks[-1].parts.append(text)
            self.blocks[-1].linked.append(self._links > 0)

    def _pop(self, k: int) -> None:
        """Closes the open elements from place k on."""
        for i in range(len(self._tags) - 1, k - 1, -1):
            tag = self._tags[i]
            self._at[tag].pop()
            if tag in BLOCKS:
                self._open_blocks.pop()
                self._new = True
            self._links -= tag == "a"
            self._banned -= self._hidden[i]
            self.last[self._ids[i + 1]] = len(self.tag) - 1
        del self._tags[k:], self._hidden[k:], self._ids[k + 1 :], self._home[k + 1 :]

    def _push(self, tag: str, attributes: str) -> None:
        label, labelled, hidden = _marked(tag, attributes)
        e, up = len(self.tag), self._ids[-1]
        home = self._home[-1]
        self.parent.append(up)
        self.tag.append(tag)
        # inline elements are no part of a path
        self.path.append(self.paths.setdefault((self.path[up], label), len(self.paths) + 1) if tag in BLOCKS else self.path[up])
        self.labelled.append(self.labelled[up] or labelled)
        self.held.append(self.held[up] or tag in ("article", "main"))
        self.classed.append("." in label)
        self.last.append(e)
        self._at[tag].append(len(self._tags))
        if tag in BLOCKS:
            self._open_blocks.append(len(self._tags))
        self._tags.append(tag)
        self._ids.append(e)
        self._home.append(e if tag in BLOCKS or labelled and not self.labelled[up] else home)
        self._hidden.append(hidden)
        self._banned += hidden
        self._links += tag == "a"

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=-1)

    def _open(self, tag: str, attributes: str) -> bool:
        """Takes in an opening tag; whether its text is raw."""
        if tag in CLOSE_P and self._at.get("p"):
            k = self._at["p"][-1]
            if k > self._last(P_SCOPE):
                self._pop(k)
        if tag in CLOSES:
            ends, scope = CLOSES[tag]
            limit = self._last(scope)
            inner = [x[i] for x in (self._at[t] for t in ends if self._at.get(t)) if (i := bisect_right(x, limit)) < len(x)]
            if inner:
                self._pop(min(inner))
        if tag in BLOCKS:
            self._new = True
        if tag == "br":
            self._text(" ")
        elif tag in RAW:
            return True
        elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCKS):
            self._push(tag, attributes)
        return False

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._text(" ")
            return
        if self._at.get(tag):
            k = self._at[tag][-1]
            # an inline element does not end blocks
            if tag in BLOCKS or not self._open_blocks or k > self._open_blocks[-1]:
                self._pop(k)
        if tag in BLOCKS:
            self._new = True

    def _read(self, source: str) -> None:
        at = pos = 0  # text that is not taken in yet begins at `at`
        quotes = True  # until a quote turns out to be left open
        while (pos := source.find("<", pos)) >= 0:
            if source.startswith("<!--", pos):
                self._text(entities.unescape(source[at:pos]))
                end = source.find("-->", pos + 4)
                at = pos = end + 3 if end >= 0 else len(source)
                continue
            name = _NAME.match(source, pos + 1)
            if name is None and source[pos + 1 : pos + 2] not in ("!", "?", "/"):
                pos += 1
                continue
            begin = name.end() if name else pos + 1
            end = source.find(">", begin)
            if end < 0:  # no tag ends from here on
                self._text(entities.unescape(source[at:pos]))
                return
            if name and quotes:
                m = _REST.match(source, begin)
                quotes = m is not None
                end = m.end() - 1 if m else end
            self._text(entities.unescape(source[at:pos]))
            at = pos = end + 1
            if name is None:
                continue
            tag = name[0].lower()
            if tag[0] == "/":
                self._close(tag[1:])
            elif self._open(tag, source[begin:end]):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, pos)
                end = source.find(">", close.end()) if close else -1
                at = pos = end + 1 if end >= 0 else len(source)
        self._text(entities.unescape(source[at:]))


def _smoothed(values: list[float]) -> list[float]:
    kernel = [math.exp(-((k / SIGMA) ** 2) / 2) for k in range(-REACH, REACH + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k in range(max(0, i - REACH), min(len(values), i + REACH + 1)):
            w = kernel[k - i + REACH]
            total += w * values[k]
            weight += w
        out.append(total / weight)
    return out


def path_ratios(blocks: list[tuple[int, int, int]]) -> tuple[dict[int, float], dict[int, float]]:
    """The fused ratio of each path, smoothed and on its own, from (path, length, marks) of blocks in page order."""
    length, marks, times = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, n, m in blocks:
        length[path] += n
        marks[path] += m
        times[path] += 1
    mean = {p: (min(length[p] / n, LENGTH), min(marks[p] / n, MARKS)) for p, n in times.items()}
    every = max(1, sum(length.values()))
    share = {p: math.sqrt(n / every) for p, n in length.items()}
    own = {p: a * (1 + b) * share[p] for p, (a, b) in mean.items()}
    # a block's series is the ratio of its path; neighbours smooth it
    a, b = (_smoothed([mean[p][k] for p, _, _ in blocks]) for k in (0, 1))
    fused = defaultdict(float)
    for (path, _, _), x, y in zip(blocks, a, b, strict=True):
        fused[path] += x * (1 + y) * share[path] / times[path]
    return dict(fused), own


def _passing(ratios: dict[int, float], weight: dict[int, float]) -> set[int]:
    best = max((v * weight[p] for p, v in ratios.items()), default=0.0)
    return {p for p, v in ratios.items() if v * weight[p] >= THRESHOLD * best and v > 0}


def main_text(source: str | None) -> str:
    """Blocks of the article, one to a line, white space within them made single spaces."""
    if not source:
        return ""
    page = Page(source)
    blocks = page.blocks
    if not blocks:
        return ""
    of = [page.path[b.element] for b in blocks]
    held = sum(b.length for b in blocks if page.held[b.element]) > 0
    weight = {p: (LABELLED if page.labelled[b.element] else 1.0) * (OUTSIDE if held and not page.held[b.element] else 1.0) for p, b in zip(of, blocks, strict=True)}
    smooth, own = path_ratios([(p, b.free, b.marks if b.free else 0) for p, b in zip(of, blocks, strict=True)])
    content, strong = _passing(smooth, weight), _passing(own, weight)
    both = content & strong or content or set(of)
    # the smallest element that holds nearly all of the content: elements are numbered from the root down
    total, inside = 0, [0] * len(page.tag)
    for p, b in zip(of, blocks, strict=True):
        if p in both:
            total += b.length
            inside[b.element] += b.length
    for e in range(len(inside) - 1, 0, -1):
        inside[page.parent[e]] += inside[e]
    home = max(e for e, n in enumerate(inside) if n >= SHARE * total)
    # its paths may go on beside it: then the smallest element around them all
    main = {p for p, b in zip(of, blocks, strict=True) if p in both and home <= b.element <= page.last[home]}
    far = max(b.element for p, b in zip(of, blocks, strict=True) if p in main)
    home = min(b.element for p, b in zip(of, blocks, strict=True) if p in main)
    while page.last[home] < far:
        home = page.parent[home]
    while home and (page.tag[home] not in BLOCKS or page.tag[home] in TEXTUAL):
        home = page.parent[home]
    up = home
    while up:  # an article or main element holds all of its text
        home = up if page.tag[up] in ("article", "main") else home
        up = page.parent[up]
    free, whole = defaultdict(int), defaultdict(int)
    for p, b in zip(of, blocks, strict=True):
        free[p] += b.free
        whole[p] += b.length
    # a path's ratio without its share of the page, for paragraphs beside a container that may have them
    alone = {p: v / math.sqrt(free[p]) if free[p] else 0.0 for p, v in own.items()}
    beside = page.parent[home] if home and page.tag[home] not in ("article", "main") else -1
    enough = BESIDE * max(alone[p] for p in main)
    within = [home <= b.element <= page.last[home] for b in blocks]
    sure = [i for i, p in enumerate(of) if p in both and within[i]]
    first, last = (sure[0], sure[-1]) if sure else (0, -1)
    out = []
    for i, (p, b) in enumerate(zip(of, blocks, strict=True)):
        tag = page.tag[b.element]
        if p in both:
            keep = True
        elif not within[i] and page.parent[b.element] == beside and tag in TEXTUAL and not page.labelled[b.element]:
            keep = tag in HEADINGS or alone[p] >= enough
        elif not within[i] or page.labelled[b.element] and not page.labelled[home]:
            keep = False
        elif tag in HEADINGS:
            keep = True
        elif free[p] < (1 - LINKS) * whole[p]:
            keep = False
        else:
            keep = tag in TEXTUAL or first < i < last and not (page.classed[b.element] and b.element != home)
        if keep:
            out.append(b.text)
    return "\n".join(out)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages without the html column and with the main text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(html)
            keep = [i for i in range(b.num_columns) if i != at]
            texts = pa.array([main_text(x.as_py()) for x in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), texts], names=[*(b.schema.names[i] for i in keep), out])

    rest = pages.drop(html)
    if out in rest.columns:
        raise ValueError(f"column {out} exists; choose another name for the text")
    return pages.mapInArrow(run, extended(rest.schema, **{out: "string"}))
