"""Main-text extraction from web pages by tag-path ratios.

A page is read once into text blocks, each with its root-to-leaf tag path (element and first class).
Text outside links and punctuation marks are aggregated per path into ratios, characters and marks a
block; the ratios, fused as the root of characters times one plus marks, are smoothed along the
page's blocks and averaged by path again. A path's score is that average, weighed by priors:

* sectioning elements (nav, footer, aside, form, ... lower, headings higher than 1) and names (a class,
  id or role whose last part is a word such as sidebar or comments: lower). A prior never removes
  anything by itself, and what wraps the whole page weighs all paths alike.
* nearness: the share of the main path's ancestors that a path shares, squared. The main path is the
  one with the most scored text.

Blocks whose path scores ``share`` of mean plus deviation of all blocks' scores, and FLOOR, are content.
So are lower ones inside the main path's container (its parent element) where that is an element
within body and no prior below the container's own speaks against them: lists, tables, short lines.

Scripts, styles, form values and elements that the page hides have no text. Character references
are decoded once, white space inside a block is one space, blocks keep page order. Unclosed tags
are closed as browsers do for paragraphs, list items and cells, else by their parents; unknown
references stay as they are. Time and memory grow with the page's length, whatever its nesting.

Null or empty html gives an empty text; so does a page of markup only. Text without any element is
content. Of main paths that tie, the first of the page is taken; equal path scores are kept or left alike. Repeated rows agree; an empty table gives no rows; other columns of the table are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from genoloom.llm.common import bounded_batches, slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|([^<]+|<)", re.S)
LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>|<[!?][^>]*>|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[^a-z0-9]+")
MARKS = re.compile(r"[.,;:!?…。，、！？；：]")

#: Elements whose content is no text of the page, read up to their end tag (without one: the first group to the page's end, the second not at all).
RAW, CLOSED_RAW = frozenset("script style".split()), frozenset("title textarea noscript iframe noembed noframes".split())
SILENT = frozenset("select datalist svg template object math canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ALSO = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Priors of elements and of the last part of a name.
ELEMENTS = {"nav": 0.05, "menu": 0.05, "footer": 0.1, "aside": 0.1, "form": 0.1, "fieldset": 0.1, "dialog": 0.1, "header": 0.3, "h1": 2.0, **{f"h{i}": 1.5 for i in range(2, 7)}}
NAMES = {
    word: weight
    for weight, words in {
        0.1: "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs"
        " footer copyright comments commentlist disqus replies newsletter subscribe signup login toolbar pager pagination widget widgets social share sharing contentinfo complementary dialog",
        0.2: "comment reply respond notice notices alert related recommended recommendations masthead search form tags",
        0.5: "header responses aside side",
    }.items()
    for word in words.split()
}
FLOOR, SPOKEN_AGAINST = 0.5, 0.75


class Paths:
    """A trie of the page's tag paths; node 0 is the root."""

    def __init__(self):
        self.parent, self.depth, self.prior, self.label = [0], [0], [1.0], [""]
        self.inner = [False]  # within an article or main element
        self.at: dict[tuple[int, str, float], int] = {}

    def child(self, parent: int, tag: str, name: str, weight: float) -> int:
        key = parent, f"{tag}.{name}", weight
        node = self.at.get(key)
        if node is None:
            node = self.at[key] = len(self.parent)
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
            self.label.append(tag)
            self.inner.append(self.inner[parent] or tag in ("article", "main"))
            if tag == "header" and self.inner[parent]:
                weight = max(weight, 0.8)  # an article's own
            self.prior.append(weight if weight > 1 else min(self.prior[parent], weight))
        return node


def _attributes(text: str, tag: str) -> tuple[str, float, bool]:
    """(first class, prior of names, hidden) of an element."""
    first, weight, hidden = "", 1.0, False
    for m in ATTRIBUTE.finditer(text):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            words = value.split()
            if key == "class" and words:
                first = words[0]
            for word in words:
                weight = min(weight, NAMES.get(PART.split(word)[-1], 1.0))
        elif key == "hidden" and value not in ("false", "until-found") or key == "aria-hidden" and value == "true":
            hidden = True
        elif key == "style" and "none" in value and re.search(r"display\s*:\s*none", value):
            hidden = True
    return first, 1.0 if tag in ("html", "body", "main", "article") else weight, hidden


def blocks(page: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """The paths, and (path, text, characters in links) of each block in page order."""
    paths = Paths()
    stack: list[tuple[str, int, bool, bool]] = []  # tag, path, silent, in a link or button
    solid: list[int] = []  # places of the elements in it that aren't inline
    open_tags: Counter = Counter()
    out: list[tuple[int, str, int]] = []
    held: list[str] = []
    linked = path = 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((path, text, linked))
            held.clear()
        linked = 0

    def cut(n: int) -> None:
        while len(stack) > n:
            open_tags[stack.pop()[0]] -= 1
        while solid and solid[-1] >= n:
            solid.pop()

    at, token = 0, TOKEN
    while at < len(page):
        m = token.match(page, at)
        if m[4] == "<" and token is TOKEN:  # a tag or quote that never ends: from here on quotes mean nothing, so that no later one is followed to the end again
            token = LOOSE
            continue
        close, tag, text = m[1], m[2], m[4]
        at = m.end()
        if text is not None:
            if stack and stack[-1][2]:
                continue
            now = stack[-1][1] if stack else 0
            if now != path:
                flush()
                path = now
            held.append(text)
            if stack and stack[-1][3]:
                linked += len(text.strip())
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append("\n")
            continue
        if not close and (tag in RAW or tag in CLOSED_RAW):
            end = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in RAW:
                at = len(page)
            else:
                unclosed.add(tag)
            continue
        if tag not in INLINE:
            flush()
        if close:
            if open_tags[tag]:
                n = len(stack) - 1
                while stack[n][0] != tag:
                    n -= 1
                cut(n)
            continue
        if tag in VOID:
            continue
        ends = ({"p"} if tag in CLOSES_P else set()) | ALSO.get(tag, set())
        if tag not in INLINE:
            ends |= {"head"} if tag not in ("head", "meta", "link", "base", "noscript", "template") else set()
            ends |= {"select", "option", "optgroup", "datalist"} if tag in CLOSES_P else set()
        while solid and ends and (stack[solid[-1]][0] in ends or stack[solid[-1]][0] == "p" and tag in ALSO and any(open_tags[x] for x in ALSO[tag])):
            cut(solid[-1])
        first, weight, hidden = _attributes(m[3], tag) if m[3] else ("", 1.0, False)
        parent, silent, link = stack[-1][1:] if stack else (0, False, False)
        node = parent
        if tag not in INLINE:
            own = ELEMENTS.get(tag, 1.0)
            node = paths.child(parent, tag, first, own if own > 1 and weight == 1 else min(own, weight))
            solid.append(len(stack))
        stack.append((tag, node, silent or hidden or tag in SILENT or tag == "head", link or tag in ("a", "button", "label")))
        open_tags[tag] += 1
    flush()
    return paths, out


def _smooth(x: list[float]) -> list[float]:
    """Gaussian smoothing over two neighbours on either side."""
    w = [math.exp(-d * d / 2) for d in (-2, -1, 0, 1, 2)]
    out = []
    for i in range(len(x)):
        part = [(w[d + 2], x[i + d]) for d in (-2, -1, 0, 1, 2) if 0 <= i + d < len(x)]
        out.append(sum(a * b for a, b in part) / sum(a for a, _ in part))
    return out


def scores(paths: Paths, found: list[tuple[int, str, int]]) -> tuple[dict[int, float], int]:
    """(score of each path that has text, the main path)."""
    total: dict[int, list[float]] = {}
    for p, text, linked in found:
        x = total.setdefault(p, [0, 0, 0, 0])
        x[0] += max(0, len(text) - linked)
        x[1] += len(MARKS.findall(text))
        x[2] += 1
        x[3] += len(text)
    ratio = {p: math.sqrt(n / k * (1 + marks / k)) for p, (n, marks, k, _) in total.items()}
    smooth: dict[int, float] = {}
    for (p, _, _), x in zip(found, _smooth([ratio[p] for p, _, _ in found]), strict=True):
        smooth[p] = smooth.get(p, 0.0) + x / total[p][2]
    # a path of links is one of links beside whatever text it stands
    fused = {p: x * paths.prior[p] * (total[p][0] / total[p][3]) for p, x in smooth.items()}
    main = max(fused, key=lambda p: (fused[p] * total[p][0], -p))
    chain, node = {0}, paths.parent[main]
    while node:
        chain.add(node)
        node = paths.parent[node]
    meet = [0] * len(paths.parent)  # depth of the last ancestor shared with the main path
    for node in range(1, len(meet)):
        meet[node] = paths.depth[node] if node in chain else meet[paths.parent[node]]
    deepest = paths.depth[paths.parent[main]]
    return {p: x * ((meet[p] + 1) / (deepest + 1)) ** 2 for p, x in fused.items()}, main


def main_text(page: str | None, share: float = 0.3) -> str:
    if not page:
        return ""
    paths, found = blocks(page)
    if not found:
        return ""
    score, main = scores(paths, found)
    every = [score[p] for p, _, _ in found]
    mean = sum(every) / len(every)
    dev = math.sqrt(sum((x - mean) ** 2 for x in every) / len(every))
    limit = max(min(share * (mean + dev), max(every)), FLOOR if share else 0.0)
    box = paths.parent[main]
    inside = [False] * len(paths.parent)
    if paths.label[box] not in ("", "html", "body"):
        inside[box] = True
        for node in range(box + 1, len(inside)):
            inside[node] = inside[paths.parent[node]]
    kept = {p for p, x in score.items() if x >= limit or (inside[p] and score[main] >= limit and paths.prior[p] >= SPOKEN_AGAINST * min(1.0, paths.prior[box]))}
    return "\n".join(t for p, t, _ in found if p in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1 << 22, "html"):
        texts = [main_text(t) for t in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    return bounded_batches(pages).select("page_id", "url", "html").mapInArrow(_extract, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
