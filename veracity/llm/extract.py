"""Operator 11: main text of web pages.

A page becomes flat text blocks. Each has its words and link density, those of the blocks before and after it, and where it stands
(heading, article or main part, content by name, boilerplate container, reader comments). A decision tree, trained
on a small labelled table of pages, says which blocks are main text. One pass over the pages, no shuffle.

Cases: a null or empty html, or a page without main text, gives the empty text; whole pages are read; tags that are never closed end with what
holds them, a comment or raw element that is never closed takes the rest of the page, a tag cut off at the end is no text; broken
character references stay as they are; white space is that of Unicode; repeated rows are extracted one by one; a missing id or url stays missing; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Rows (blocks) of the labelled table that the tree is trained on at most; its depth and smallest leaf.
TRAIN_ROWS, DEPTH, LEAF = 20_000, 12, 2
#: The columns that the tree reads. Words and densities are 0 beside the first and last block.
FEATURES = ("comments", "boilerplate", "scoped_page", "in_scope", "named", "heading", "words", "link_density", "words_before", "density_before", "words_after", "density_after")

# Fixed values of HTML: elements that make blocks, that have no content, whose content isn't parsed, whose content is no text of the page.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
SILENT = frozenset("audio button canvas datalist noscript object select svg template video".split())
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An element that ends when one of the same kind begins in the same place.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}

# Words of class, id and role that name a container.
COMMENTS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
BOILERPLATE = frozenset(
    """ad ads adv advert advertisement advertising adverts adsbygoogle alert aside banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies
    copyright dialog footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion
    recommended related search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar trending widget""".split()
)
HEADER = frozenset(("header",))
CONTENT = frozenset(("article", "content", "entry", "post", "story"))

_END = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass(frozen=True)
class Place:
    """What the open elements say of a text: scope is 1 in a main part, 2 in an article; boilerplate is 1 in a header, 2 in
    another container, between the scope and the text."""

    scope: int = 0
    boilerplate: int = 0
    comments: bool = False
    named: bool = False
    silent: bool = False
    heading: bool = False
    marked: bool = False  # labelled as main text

    def within(self, tag: str, attributes: dict[str, str]) -> Place:
        if tag in SILENT:
            return replace(self, silent=True)
        said = set(_TOKEN.findall(_CAMEL.sub(r"\1 \2", " ".join(attributes.get(k, "") for k in ("class", "id", "role"))).lower())) if attributes else set()
        if tag in ("html", "body"):
            said = set()
        comments = self.comments or bool(said & COMMENTS)
        scope, boilerplate, named = self.scope, self.boilerplate, self.named
        role = attributes.get("role", "").lower()
        if tag in ("article", "main") or role in ("article", "main"):
            scope, boilerplate, named = max(scope, 2 if "article" in (tag, role) else 1), 0, named
        else:
            named = named or bool(said & CONTENT)
            hidden = "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            if tag in ("nav", "footer", "aside", "form", "dialog", "menu", "search") or said & BOILERPLATE or hidden:
                boilerplate = 2
            elif tag == "header" or said & HEADER:
                boilerplate = max(boilerplate, 1)
        return Place(scope, boilerplate, comments, named, self.silent, self.heading or tag in HEADING, self.marked or "data-main" in attributes)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    place: Place


def _tags(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind text, start or end; comments, declarations and raw elements are left out."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        after = page[lt + 1 : lt + 2]
        if after == "!" or after == "?" or after == "/" and not _NAME.match(page, lt + 2):
            if page.startswith("<!--", lt):
                close = re.compile(r"--!?>|(?<=<!--)-?>").search(page, lt + 4)
                at = close.end() if close else n
            else:
                close = page.find(">", lt)
                at = close + 1 if close >= 0 else n
            continue
        end = after == "/"
        name = _NAME.match(page, lt + 1 + end)
        if not name:
            yield "text", "<", ""
            at = lt + 1
            continue
        close = _END.match(page, name.end())
        if not close:
            return
        tag, at = name.group().lower(), close.end()
        yield "end" if end else "start", tag, "" if end else page[name.end() : at - 1]
        if not end and tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            at = stop.start() if stop else n


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in their order, without empty ones. Time is linear in the page."""
    out: list[Block] = []
    place, stack, opened = Place(), [], Counter()  # stack: (tag, place outside)
    parts, words, linked, link = [], 0, 0, -1  # link: the depth at which a link is open

    def flush() -> None:
        nonlocal words, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, len(text.split(" ")), linked, place))
        parts.clear()
        words = linked = 0

    def close() -> None:
        nonlocal place, link
        tag, place = stack.pop()
        opened[tag] -= 1
        if len(stack) < link:
            link = -1

    for kind, name, rest in _tags(page or ""):
        if kind == "text":
            if not place.silent:
                text = html.unescape(name) if "&" in name else name
                parts.append(text)
                if link >= 0:
                    linked += len(text.split())
        elif kind == "end":
            if name == "a":
                link = -1
            if opened[name]:
                if name not in SILENT:
                    flush()
                while stack[-1][0] != name:
                    close()
                close()
            elif name in BLOCK:
                flush()
        else:
            if name == "br":
                parts.append(" ")
            attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)} if rest.strip(" /\n\t") else {}
            inner = place.within(name, attributes) if attributes or name in BLOCK or name in SILENT else place
            if name in BLOCK:
                flush()
                if stack and (stack[-1][0] == "p" or stack[-1][0] in ENDS.get(name, ())):
                    close()
                    inner = place.within(name, attributes)
                    if name == "tr" and stack and stack[-1][0] == "tr":
                        close()
                        inner = place.within(name, attributes)
            if name == "a":
                link = len(stack) if "href" in attributes else -1
            if name not in VOID and name not in ("html", "body") and (name in BLOCK or inner != place or opened[name]):
                if inner != place and name not in SILENT:
                    flush()
                stack.append((name, place))
                opened[name] += 1
                place = inner
    flush()
    return out


def describe(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of a page."""
    n = len(found)
    words = np.array([b.words for b in found], float)
    density = np.minimum(np.array([b.linked for b in found], float) / np.maximum(words, 1), 1)
    scope = max((b.place.scope for b in found if not b.place.boilerplate and not b.place.comments), default=0)
    x = np.zeros((n, len(FEATURES)))
    for i, b in enumerate(found):
        p = b.place
        x[i, :6] = p.comments, p.boilerplate, scope > 0, 0 < scope == p.scope, p.named, p.heading
    x[:, 6], x[:, 7] = words, density
    x[1:, 8], x[1:, 9], x[:-1, 10], x[:-1, 11] = words[:-1], density[:-1], words[1:], density[1:]
    return x


@dataclass
class Tree:
    """Nodes in rows: feature (-1 in a leaf), threshold, child for values up to it, child above it, verdict."""

    feature: list[int]
    threshold: list[float]
    low: list[int]
    high: list[int]
    main: list[bool]

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF) -> Tree:
        """Splits of least Gini impurity; of equal ones the first feature and smallest threshold."""
        tree = Tree([], [], [], [], [])

        def grow(rows: np.ndarray, left: int) -> int:
            node, good = len(tree.feature), y[rows].sum()
            for column, value in ((tree.feature, -1), (tree.threshold, 0.0), (tree.low, -1), (tree.high, -1), (tree.main, bool(2 * good >= len(rows) and len(rows)))):
                column.append(value)
            if not left or good in (0, len(rows)):
                return node
            best, chosen = good * (len(rows) - good) / len(rows), None
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, below = x[order, f], np.cumsum(y[order])[:-1]
                n_low = np.arange(1, len(order))
                n_high, above = len(order) - n_low, good - below
                impurity = below * (n_low - below) / n_low + above * (n_high - above) / n_high
                impurity[(v[1:] == v[:-1]) | (n_low < leaf) | (n_high < leaf)] = np.inf
                k = int(np.argmin(impurity)) if len(impurity) else 0
                if len(impurity) and impurity[k] < best - 1e-9:
                    best, chosen = impurity[k], (f, (v[k] + v[k + 1]) / 2)
            if chosen:
                f, cut = chosen
                low = x[rows, f] <= cut
                tree.feature[node], tree.threshold[node] = f, cut
                tree.low[node] = grow(rows[low], left - 1)
                tree.high[node] = grow(rows[~low], left - 1)
            return node

        grow(np.arange(len(y)), depth)
        return tree

    def keeps(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, low, high = (np.array(c) for c in (self.feature, self.threshold, self.low, self.high))
        node, rows = np.zeros(len(x), int), np.arange(len(x))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            node[rows] = np.where(x[rows, feature[at]] <= threshold[at], low[at], high[at])
        return np.array(self.main)[node] if len(x) else np.zeros(0, bool)


def filled(page: str, times: float) -> str:
    """A page of the labelled table: {n} stands for n words, or times as many where n is 10 or more."""
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(f"word{i}" for i in range(int(m[1]) if int(m[1]) < 10 else max(10, round(int(m[1]) * times)))), page)


_MENU = "<ul>" + '<li><a href="/">{1}</a></li><li><a href="/">{2}</a></li><li><a href="/">{3}</a></li>' * 2 + "</ul>"
_LINKS = '<a href="/">{2}</a> <a href="/">{3}</a> <a href="/">{1}</a> <a href="/">{2}</a>'
_HEAD = "<h1 data-main>{6}</h1>"
_PROSE = "<p data-main>{40}</p><p data-main>{1}</p><p data-main>{75}</p><p data-main>{3}</p><h2 data-main>{4}</h2><p data-main>{12}</p><p data-main>{120}</p>"
_RICH = "<ul><li data-main>{6}<li data-main>{15}</ul><p data-main><a href='/'>{4}</a></p><table><tr><td data-main>{1}<td data-main>{2}</table><blockquote data-main>{30}</blockquote><figure><figcaption data-main>{6}</figcaption></figure><p data-main><a href='/'>{30}</a> {10}</p>"
_JUNK = f"<div class='ad banner'>{{14}}</div><aside><h3>{{2}}</h3><p>{{30}}</p></aside><div class=share>{_LINKS}</div><form class=newsletter><p>{{25}}</p></form>"
_COMMENTS = "<section id=comments><h2>{2}</h2><p>{35}</p><div>{60}</div><p>{1}</p><article class=comment><p>{40}</p><p>{12}</p></article></section>"
#: What stands before and after the main part of a page.
BEFORE = (f"<nav>{_MENU}</nav><div class=ad>{{12}}</div>", f"<header>{{4}}<h2>{{7}}</h2><nav>{_MENU}</nav></header>", "<div id=cookie-consent><p>{30}</p><button>{2}</button></div><form class=search>{3}</form>", "<header><h1>{2}</h1><p>{9}</p><div>{1}</div></header><div class=header><h2>{1}</h2><p>{3}</p><p>{12}</p></div>", f"<div>{_LINKS}</div><div>{{2}}</div>")
AFTER = (f"<footer>{_LINKS}<p>{{15}}</p></footer>", f"{_COMMENTS}<div class=copyright>{{9}}</div>", f"<div class=sidebar><h3>{{2}}</h3><p>{{50}}</p>{_MENU}</div>", f"<div class=related>{_LINKS}</div><div class=comment-list><div>{{90}}</div><div>{{2}}</div></div><footer>{{70}}</footer>", f"<div>{{5}} {_LINKS}</div><p>{{4}}</p>")
#: Main parts that an element or a name sets apart, and ones that only words and links tell.
SET_APART = (
    f"<article>{_HEAD}{_PROSE}</article>",
    f"<article><header>{_HEAD}<p>{{4}}</p></header>{_PROSE}{_JUNK}{_RICH}{_COMMENTS}</article>",
    f"<article><header><h1 data-main>{{2}}</h1><p>{{9}}</p></header>{_PROSE}</article>",
    f"<article><header><h1 data-main>{{9}}</h1><p>{{1}}</p><p>{{3}}</p><p>{{12}}</p></header>{_PROSE}</article>",
    "<article><h1 data-main>{1}</h1><p data-main>{1}</p><p data-main>{2}</p></article>",
    f"<main><nav>{_MENU}</nav>{_HEAD}{_RICH}{_PROSE}{_JUNK}<p data-main>{{5}}</p></main>",
    f"<main><div>{{20}}</div><article>{_PROSE}{_RICH}</article><article><h2 data-main><a href='/'>{{5}}</a></h2><p data-main>{{30}}</p></article><p>{{18}}</p><div>{{3}}</div>{_COMMENTS}</main>",
)
NAMED = (f"<div id=content>{_HEAD}{_PROSE}{_JUNK}{_RICH}{_COMMENTS}</div>", f"<div class=post-entry>{_HEAD}{_PROSE}<p data-main>{{2}}</p></div>")
PLAIN = (f"{_HEAD}{_PROSE}<p data-main>{{60}}</p>", "<p data-main>{35}</p><p data-main>{10}</p><p data-main>{45}</p>", f"<table><tr><td>{_LINKS}<td>{{3}}<tr><td data-main>{{50}}<td data-main>{{80}}<tr><td>{_LINKS}<td>{{6}}</table>", "<div><a href='/'>{1}</a></div><div><a href='/'>{2}</a></div><div>{5}</div><div><a href='/'>{12}</a></div><div>{3}</div>")
#: Blocks without a name, which are no main text where an element sets the main part apart.
_LOOSE = "<div>{1}</div><div>{30}</div><h3>{3}</h3><p>{8}</p><div>{80}</div><p>{15}</p>"


def labelled_pages() -> list[str]:
    """The labelled table: main blocks carry data-main, which no feature reads. Each main part with all that may stand around it, in two sizes."""
    pages = [before + body + after for body in (*SET_APART, *NAMED, *PLAIN) for before in BEFORE for after in AFTER]
    pages += [before + body + after for body in SET_APART for before in (_LOOSE, "<p>{45}</p>") for after in (_LOOSE, "<div>{60}</div>")]
    return [filled(page, times) for page in pages for times in (0.5, 2.0)]


_ROW = "page_id bigint, block int, text string, main boolean, features array<double>"


def labelled_table(spark: SparkSession) -> DataFrame:
    """The labelled pages (page_id, html)."""
    return spark.createDataFrame(list(enumerate(labelled_pages())), "page_id bigint, html string")


def text_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block (its number in the page), text, main (whether a data-main attribute labels it), features in the order of FEATURES."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "html"):
                out: list[tuple] = []
                for page_id, page in zip(rows["page_id"].to_pylist(), rows["html"].to_pylist(), strict=True):
                    found = blocks(page)
                    out += [(page_id, i, b.text, b.place.marked, x) for i, (b, x) in enumerate(zip(found, describe(found).tolist(), strict=True))]
                columns = list(zip(*out, strict=True)) if out else [()] * 5
                types = (pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "block", "text", "main", "features"])

    return pages.select("page_id", "html").mapInArrow(run, _ROW)


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Tree:
    """The tree of a labelled table of blocks (features, main), on at most `rows` of them, chosen by a hash."""
    chosen = labelled.select("features", "main").orderBy(F.xxhash64("features", "main", F.lit(5)), "features", "main").limit(rows).collect()
    return Tree.fit(np.array([r["features"] for r in chosen], float).reshape(-1, len(FEATURES)), np.array([r["main"] for r in chosen], bool))


def extract(pages: DataFrame, tree: Tree) -> DataFrame:
    """page_id, url, text (main blocks joined by \\n), n_chars (code points), n_blocks, n_main_blocks."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "html"):
                found = [blocks(page) for page in rows["html"].to_pylist()]
                kept = tree.keeps(np.concatenate([describe(f) for f in found]))
                texts, counts, at = [], [], 0
                for f in found:
                    mine = kept[at : at + len(f)]
                    at += len(f)
                    texts.append("\n".join(b.text for b, k in zip(f, mine, strict=True) if k))
                    counts.append(int(mine.sum()))
                columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(counts, pa.int64())]
                yield from pa.table([rows["page_id"], rows["url"], *columns], ["page_id", "url", "text", "n_chars", "n_blocks", "n_main_blocks"]).combine_chunks().to_batches()

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_main_blocks bigint")
