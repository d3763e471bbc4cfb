"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf tag path (tags with class names). Per
path the blocks' text length and punctuation are summed; length per block outside links and
punctuation per block are two scores of a path. Both are smoothed along the page inside each
container, fused by product, weighed by what tags and names say (softly: inside an element that is
named ``widget`` all weigh alike, so nothing is lost), and held against a threshold. The paths above it
select the content; the one that holds the most is the core. What is put out is selected blocks near
the core, and short ones among them (``main_text``).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.llm.common import bounded, column, decoded, mapped

COMMENT = re.compile(r"--!?>")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: To the end of a tag, past quoted values; never goes back.
REST = re.compile(r"((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements nested deeper than this lie flat.
DEPTH = 512
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What an article's own text is marked up with; other blocks are containers.
TEXTUAL = INLINE | HEADINGS | {"p", "li", "ul", "ol", "dl", "dt", "dd", "pre", "blockquote", "figure", "figcaption", "hgroup"}
#: An opening tag here ends an open one there.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "aside", "nav", "main", "header", "footer", "form", "body", "select", "blockquote", "figure"}
ENDS_P = SCOPES | HEADINGS | {"p", "pre", "hr", "address", "details", "fieldset", "figcaption", "hgroup"}
#: No text of a page.
NEVER = {"script", "style", "head", "title", "noscript", "template", "iframe", "svg", "object", "canvas", "button", "select", "textarea", "noembed", "noframes", "xmp", "audio", "video"}
#: Tags that say what they hold; they weigh the scores of what is inside.
ASIDE = {"nav", "aside", "form", "footer", "menu", "dialog"}
#: Words in class, id or role that say the same, but less surely.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banners?|breadcrumbs?|comments?|commentlist|consent|cookies?|discussion|disqus|footer|gdpr|login|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|overlay|pagination|pager|paywall|popup|promos?|promoted|recommended|related|replies|reply|respond|search|share|sharing|sidebars?|signup|skip|social|sponsors?|sponsored|subscribe|tags|toolbar|topbar|widgets?|complementary|contentinfo|alert)(?:$|[\s_-])",
    re.I,
)
#: The last is for text that stands in a container without a paragraph of its own.
TAG_WEIGHT, NAME_WEIGHT, ARTICLE_WEIGHT, LOOSE_WEIGHT = 0.1, 0.3, 10.0, 0.4
MARKS = re.compile(r"[.,;:!?。、，；：！？]")
RIGHTS = re.compile(r"(?:©|\(c\) |copyright\b)", re.I)


class Node:
    """An element: tag, depth, number of its tag path on the page, weight by what tags and names say, own and with those above."""

    __slots__ = ("tag", "up", "depth", "path", "never", "own", "weight", "link", "article", "label")

    def __init__(self, tag: str, attributes: str, up: Node | None, paths: dict[tuple[int, str], int]):
        names, hidden = "", False
        if attributes:
            for key, *values in ATTRIBUTE.findall(attributes):
                key = key.lower()
                if key in ("class", "id", "role"):
                    names += " " + "".join(values)
                hidden |= key == "hidden" or key == "aria-hidden" and "".join(values) == "true" or key == "style" and "display:none" in "".join(values).replace(" ", "")
        self.label = f"{tag}.{'.'.join(sorted(names.split()))}" if names else tag
        self.tag, self.up = tag, up
        self.depth = up.depth + 1 if up else 0
        self.path = paths.setdefault((up.path if up else -1, self.label), len(paths))
        self.never = bool(up and up.never or tag in NEVER)
        self.link = tag == "a" or bool(up and up.link)
        self.article = tag in ("article", "main") or bool(up and up.article)
        self.own = 1.0
        if hidden or tag in ASIDE or tag == "header" and not (up and up.article):
            self.own = TAG_WEIGHT
        elif tag in ("article", "main"):
            self.own = 1.0 if up and up.article else ARTICLE_WEIGHT
        elif names and tag not in ("html", "body") and NAMES.search(names):
            self.own = NAME_WEIGHT
        self.weight = (up.weight if up else 1.0) * self.own


class Block:
    """A run of text without a block-level tag inside: its element, text, characters, those in links, marks."""

    __slots__ = ("node", "text", "chars", "linked", "marks")

    def __init__(self, node: Node, runs: list[tuple[Node, str]]):
        while node.tag in INLINE and node.up:
            node = node.up
        self.node = node
        self.text = " ".join("".join(t for _, t in runs).split())
        self.chars = len(self.text)
        self.linked = sum(len(" ".join(t.split())) for n, t in runs if n.link)
        self.marks = len(MARKS.findall(self.text))


def text_runs(html: str) -> list[tuple[Node, str, int]]:
    """(element, text, block number) of each run of text; runs of the same block stand without white space between.

    One pass: a tag whose quotes never close ends at its first ``>``, and so do all after it.
    """
    paths: dict[tuple[int, str], int] = {}
    stack, out, at, block, quoted = [Node("#root", "", None, paths)], [], 0, 0, True
    unclosed: set[str] = set()

    def add(text: str) -> None:
        if text and not stack[-1].never:
            out.append((stack[-1], text, block))

    while at < len(html):
        begin = html.find("<", at)
        if begin < 0:
            add(unescape(html[at:]))
            break
        tag = TAG.match(html, begin)
        if not tag:
            mark = html[begin + 1 : begin + 2]
            if mark not in ("!", "?", "/"):  # a bare sign
                after = html.find("<", begin + 1)
                after = len(html) if after < 0 else after
                add(unescape(html[at:after]))
                at = after
                continue
            add(unescape(html[at:begin]))
            if html.startswith("<!--", begin):
                end = COMMENT.search(html, begin + 2)
                at = end.end() if end else len(html)
            elif html.startswith("<![CDATA[", begin):
                end = html.find("]]>", begin)
                add(html[begin + 9 : end if end >= 0 else len(html)])
                at = end + 3 if end >= 0 else len(html)
            else:
                end = html.find(">", begin)
                at = end + 1 if end >= 0 else len(html)
            continue
        if begin > at:
            add(unescape(html[at:begin]))
        rest = REST.match(html, tag.end()) if quoted else None
        if rest:
            attributes, at = rest[1], rest.end()
        else:
            quoted = False
            end = html.find(">", tag.end())
            end = len(html) if end < 0 else end
            attributes, at = html[tag.end() : end], end + 1
        name = tag[2].lower()
        block += name not in INLINE
        if tag[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
                if name in INLINE and stack[i].tag in SCOPES:
                    break
            continue
        if name in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SCOPES:
                    break
                if stack[i].tag == "p":
                    del stack[i:]
                    break
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ENDS.get(name, ()):
                del stack[i:]
                break
            if stack[i].tag in SCOPES:
                break
        if name in VOID:
            continue
        if name in RAW:
            close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if not close:
                unclosed.add(name)
            at = close.end() if close else len(html)
        elif len(stack) < DEPTH:
            stack.append(Node(name, attributes, stack[-1], paths))
    return out


def blocks_of(html: str) -> list[Block]:
    """The page's blocks of text in order, empty ones left out."""
    out: list[Block] = []
    runs: list[tuple[Node, str]] = []
    number = -1
    for node, text, block in [*text_runs(html), (None, "", -2)]:
        if block != number and runs:
            made = Block(runs[0][0] if len(runs) == 1 else min((n for n, _ in runs), key=lambda n: n.depth), runs)
            if made.chars:
                out.append(made)
            runs = []
        number = block
        runs.append((node, text))
    return out


def path_scores(blocks: list[Block]) -> np.ndarray:
    """Fused score of each block: its tag path's text length and punctuation, each per block and smoothed along the page, multiplied.

    Text inside links doesn't count as length. Smoothing stays among blocks of one container, so that what stands beside an article gains nothing from it.
    """
    chars, linked, marks, count = (defaultdict(float) for _ in range(4))
    for x in blocks:
        chars[x.node.path] += x.chars
        linked[x.node.path] += min(x.linked, x.chars)
        marks[x.node.path] += x.marks
        count[x.node.path] += 1
    length = {p: (chars[p] - linked[p]) / count[p] * np.log2(2 + chars[p]) for p in chars}
    points = {p: 0.05 + marks[p] / count[p] for p in chars}
    places: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(blocks):
        places[id(container_of(x.node))].append(i)
    out = np.zeros(len(blocks))
    kernel = np.array([0.06, 0.24, 0.4, 0.24, 0.06])
    for at in places.values():
        smooth = []
        for score in (length, points):
            values = [score[blocks[i].node.path] for i in at]
            smooth.append(np.convolve([values[0]] * 2 + values + [values[-1]] * 2, kernel, mode="valid"))
        out[at] = smooth[0] * smooth[1] * [blocks[i].node.weight for i in at]
    return out


def container_of(node: Node) -> Node:
    while node.tag in TEXTUAL and node.up:
        node = node.up
    return node


def content_paths(blocks: list[Block], fused: np.ndarray) -> tuple[set[int], int]:
    """Tag paths above the threshold, and of them the one that holds the most."""
    sizes = np.array([x.chars for x in blocks], dtype=float)
    threshold = max(1e-9, min(fused.mean(), 0.5 * np.average(fused, weights=sizes)))
    total: dict[int, float] = defaultdict(float)
    best: dict[int, float] = defaultdict(float)
    for x, score in zip(blocks, fused):
        total[x.node.path] += x.chars * x.node.weight * min(1.0, 0.25 + x.marks) * (1.0 if x.node.tag in TEXTUAL else LOOSE_WEIGHT)
        best[x.node.path] = max(best[x.node.path], score)
    chosen = {p for p in total if best[p] >= threshold}
    return chosen, max(chosen or total, key=lambda p: (total[p], -p))


def ancestors(node: Node | None) -> list[Node]:
    out = []
    while node:
        out.append(node)
        node = node.up
    return out


def main_text(html: str | None) -> str:
    """The article's text: blocks in page order, white space inside a block as one space, joined by one space.

    The blocks of the content path that holds the most are the core. Its home is the deepest element with most of it. Inside the
    home go blocks of content paths, and others between them or in textual elements after them, but lists of links and what tags or names call
    something else. Beside the home, going up, go further parts that content paths fill: those before it, and after it those alike or of similar weight.
    """
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    chosen, core_path = content_paths(blocks, path_scores(blocks))
    weight: dict[Node, float] = defaultdict(float)
    for x in blocks:
        if x.node.path == core_path:
            for node in ancestors(x.node):
                weight[node] += x.chars
    most = 0.8 * max(weight.values())
    home = max((e for e in weight if weight[e] >= most and (e.tag not in TEXTUAL or not e.up)), key=lambda e: e.depth)
    line = ancestors(home)
    for e in line:  # an article is one, however deep its core lies
        if e.tag in ("article", "main"):
            home, line = e, ancestors(e)
            break
    on_line = set(line)
    parts = _parts(blocks, home, on_line)
    keep = [False] * len(blocks)
    for top, under, places in parts:
        if under is home:
            continue
        _beside(blocks, top, under, places, places[0] > parts_end(parts, home), chosen, weight[home], on_line, keep)
    _inside(blocks, home, [i for _, under, places in parts if under is home for i in places], chosen, core_path, keep)
    last = max((i for i, k in enumerate(keep) if k), default=-1)
    if last > 0 and blocks[last].chars < 300 and RIGHTS.match(blocks[last].text):
        keep[last] = False
    return " ".join(x.text for x, k in zip(blocks, keep) if k)


def _parts(blocks: list[Block], home: Node, on_line: set[Node]) -> list[tuple[Node, Node, list[int]]]:
    """Neighboring blocks under one child of an element on the line from the page's root to ``home``: (child, that element, places)."""
    out: list[tuple[Node, Node, list[int]]] = []
    for i, x in enumerate(blocks):
        top = under = x.node
        while under not in on_line:
            top, under = under, under.up
        if out and out[-1][1] is under and (out[-1][0] is top or under is home):
            out[-1][2].append(i)
        else:
            out.append((top, under, [i]))
    return out


def parts_end(parts: list[tuple[Node, Node, list[int]]], home: Node) -> int:
    return min((places[0] for _, under, places in parts if under is home), default=0)


def _named_aside(node: Node, stop: Node) -> bool:
    """Whether tags or names between a block and the element above call it something else."""
    while node is not stop:
        if node.own < 1:
            return True
        node = node.up
    return False


def _beside(blocks: list[Block], top: Node, under: Node, places: list[int], after: bool, chosen: set[int], core: float, on_line: set[Node], keep: list[bool]) -> None:
    good = [i for i in places if not _named_aside(blocks[i].node, under)]
    chars, linked = sum(blocks[i].chars for i in good), sum(blocks[i].linked for i in good)
    if not good or 2 * linked > chars:
        return
    filled = sum(blocks[i].chars for i in good if blocks[i].node.path in chosen)
    heading = any(blocks[i].node.tag in ("h1", "h2") for i in good)
    alike = top.tag in ("article", "section") or "." in top.label
    alike &= any(e.up is under and e.label == top.label for e in on_line)
    fits = 2 * filled >= chars
    if not after:
        fits = fits and any(blocks[i].node.tag in TEXTUAL and blocks[i].node.tag not in INLINE for i in good) or heading and chars < 300
    else:
        fits = fits and (alike or 2 * filled >= core)
    for i in good:
        keep[i] = keep[i] or bool(fits)


def _inside(blocks: list[Block], home: Node, places: list[int], chosen: set[int], core_path: int, keep: list[bool]) -> None:
    groups: dict[Node, list[int]] = defaultdict(list)
    for i in places:  # a list or container inside the home stands or falls by its links
        node, unit = blocks[i].node, None
        while node is not home:
            if node.tag not in ("p", "li") and node.tag not in HEADINGS:
                unit = node
            node = node.up
        groups[unit or home].append(i)
    good = []
    for unit, members in groups.items():
        chars, linked = sum(blocks[i].chars for i in members), sum(blocks[i].linked for i in members)
        if unit is home or 2 * linked <= chars or any(blocks[i].node.path == core_path for i in members):
            good += [i for i in members if not _named_aside(blocks[i].node, home)]
    good.sort()
    selected = [i for i in good if blocks[i].node.path in chosen and 2 * blocks[i].linked <= blocks[i].chars]
    if not selected:
        selected = good
    if not selected:
        return
    first, last = selected[0], selected[-1]
    cores = [i for i in good if blocks[i].node.path == core_path] or selected
    heads = [i for i in good if i < cores[0] and blocks[i].node.tag in HEADINGS]
    if heads:
        first = min(first, heads[-1]) if not (first < heads[-1] and blocks[first].node.tag not in TEXTUAL) else heads[0]
    whole = home.tag in ("article", "main")
    for i in good:
        if whole or first <= i <= last or i > last and blocks[i].node.tag in TEXTUAL:
            keep[i] = True


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, "html"):
        texts = [main_text(h) for h in decoded(column(batch, "html"))]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` (code points) for every row of ``pages``; no shuffle.

    A null or empty html, or one without an article, gives an empty text and 0. Nothing is cut at
    any length. Null ids and urls and repeated rows stay as they are; other columns are not read.
    Bytes that are no UTF-8 count as U+FFFD. Empty in, empty out.
    """
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return mapped(kept, _extract, "page_id long, url string, text string, n_chars long")
