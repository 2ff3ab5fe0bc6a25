"""HTML extraction from flat text blocks.

A page is read as a flat list of text blocks. Each block is described by its number of words,
the share of its words that are links, the same of its two neighbours, and the zone of the
page that its innermost telling element puts it in. A decision tree, grown on the small
labelled table below, says which blocks are main text.

Defined results: NULL or empty html gives an empty text; broken markup is read as far as it
goes, and an element whose closing tag is missing hides nothing but its tag (an open script or
style hides the rest); self-closing tags are honoured; equal rows give equal results, once per row; pages of any
length are read whole; an empty table gives an empty one. Extra columns pass through, whatever their names; the text takes the place of
a column of its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assayline.llm.columns import given_back, numbered

CHUNK = 256

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
_MARK = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Elements without any main text: their content goes as a whole.
_SKIPPED = {"script", "style", "noscript", "template", "svg", "head", "iframe", "object", "canvas", "select", "textarea", "button", "math", "audio", "video", "map", "title"}
_RAW = {"script", "style"}
# What may stand in a head; anything else ends it.
_HEAD = {"title", "style", "script", "noscript", "template"}
_HEAD_TAGS = {"html", "head", "meta", "link", "base", "basefont", "bgsound"}
_PAIRED = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*+(?<!/)>.*?(?:</\1\s*>|\Z)"""
    rf"""|<(/?)({"|".join(sorted(_SKIPPED - _RAW - {"head"}))})(?=[\s/>])((?:[^"'>]|"[^"]*+"|'[^']*+')*+|[^>]*+)>""",
    re.S | re.I,
)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_UNQUOTED_END = re.compile(r"""=\s*[^\s"'>]*/\Z""")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br",
}
_IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "body", "blockquote"}
# Zones: 1 main text, -1 what surrounds it, 0 neither, DOUBTFUL perhaps what surrounds it.
DOUBTFUL = -0.5
_ZONES = {"article": 1, "main": 1, "nav": -1, "footer": -1, "aside": -1, "form": -1, "dialog": -1, "menu": -1, "fieldset": -1}
_AROUND = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs "
    "sidebar widget widgets related recommended footer masthead toolbar pagination pager cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond reply replies form search copyright "
    "disclaimer legal toc skip hidden".split()
)
# Parts of a layout: within a longer name (page-sidebar-left) it may be that of a wrapper of all.
_LAYOUT = {"sidebar", "nav", "navbar", "menu", "banner", "footer", "masthead", "toolbar", "toc", "search", "share", "sharing", "social", "widget", "widgets"}
# Words beside which another word tells a state or a topic (has-sidebar, comments-open, tag-search).
_STATE_BEFORE = {"has", "with", "without", "no", "not", "category", "tag", "type", "format", "status"}
_STATE_AFTER = {"open", "closed", "on", "off", "enabled", "disabled"}
_AROUND_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
_MAIN = {"article", "entry", "post", "story", "content", "main"}
_BODY = {"body", "content", "text"}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    zone: float

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def zone_of(tag: str, attributes: str, inside: float) -> float | None:
    """Zone that an element opens, None if it says nothing."""
    zone = _ZONES.get(tag)
    if tag == "header":
        zone = None if inside > 0 else -1
    found: set[str] = set()
    names: list[list[str]] = []
    container = tag == "main" or tag == "article" and inside == 0
    for name, value in _MARK.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return -1
        if name == "role":
            zone = 1 if value in ("main", "article") else -1 if value in _AROUND_ROLES else zone
            container |= value == "main"
        elif name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in _WORDS.findall(token)]
                if not words or words[0] in _STATE_BEFORE or words[-1] in _STATE_AFTER:
                    continue
                names.append(words)
                found.update(words)
                if tag == "article":
                    container |= inside >= 0 and len(words) == 1 and words[0] in _MAIN
                elif name == "id" and tag in ("div", "section", "td"):
                    container |= inside >= 0 and found_main(words)
    if found & _AROUND and tag not in ("body", "html") and not container:
        layout = all(len(words) > 1 and set(words) & _AROUND <= _LAYOUT for words in names if set(words) & _AROUND)
        return DOUBTFUL if layout and tag in ("div", "section", "td", "article") else -1
    if "header" in found and inside <= 0 and not found & _MAIN:
        return -1
    if zone is None and inside in (0, DOUBTFUL) and tag in ("div", "section", "td") and (found & _MAIN and found & _BODY or container):
        return 1
    return zone


def found_main(words: list[str]) -> bool:
    """Whether all words of an id name the main text (content, main-content, article-body)."""
    return bool(set(words) & _MAIN) and set(words) <= _MAIN | _BODY


def self_closed(attributes: str) -> bool:
    """Whether a tag ends in a slash of its own, not in that of an unquoted value."""
    return attributes.endswith("/") and not _UNQUOTED_END.search(attributes)


def ends_of(html: str) -> dict[int, int]:
    """Where skipped elements end, by where their opening tags start; only those that are closed."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for hit in _PAIRED.finditer(html):
        if not hit[3]:
            continue
        of_tag = opened.setdefault(hit[3].lower(), [])
        if not hit[2]:
            if not self_closed(hit[4]):
                of_tag.append(hit.start())
        elif of_tag:
            ends[of_tag.pop()] = hit.end()
    return ends


def raw_end(html: str, tag: str, at: int) -> int:
    """End of a script or style, the end of the page if it is open."""
    hit = _RAW_END[tag].search(html, at)
    return hit.end() if hit else len(html)


def head_end(html: str, at: int, ends: dict[int, int]) -> int:
    """End of a head: behind its closing tag, or before the first text or element that cannot stand in it."""
    while (hit := _TOKEN.search(html, at)) and not html[at : hit.start()].strip():
        closing, tag, attributes = (hit[1], hit[2], hit[3]) if hit[2] else (hit[4], hit[5], hit[6])
        tag = (tag or "").lower()
        if closing and tag == "head":
            return hit.end()
        if closing and tag in ("html", "body") or tag and not closing and tag not in _HEAD | _HEAD_TAGS:
            return hit.start()
        at = hit.end()
        if tag in _HEAD and not closing and not self_closed(attributes):
            at = raw_end(html, tag, at) if tag in _RAW else ends.get(hit.start(), at)
    return at


def blocks_of(html: str) -> list[Block]:
    """Text blocks of a page in order."""
    blocks: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, float]] = [("", 0)]
    current: float = 0

    def close() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            linked = len(unescape(" ".join(links)).split())
            blocks.append(Block(text, len(text.split()), linked, current))
        parts.clear()
        links.clear()

    def put(piece: str) -> None:
        if piece:
            parts.append(piece)
            if any(t == "a" for t, _ in stack):
                links.append(piece)

    at, size = 0, len(html)
    ends: dict[int, int] | None = None
    while at < size:
        hit = _TOKEN.search(html, at)
        if hit is None:
            put(html[at:])
            break
        put(html[at : hit.start()])
        at = hit.end()
        closing, tag, attributes = (hit[1], hit[2], hit[3]) if hit[2] else (hit[4], hit[5], hit[6])
        if not tag:
            if hit[0].startswith("<![CDATA["):
                put(hit[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE:
            close()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            current = stack[-1][1]
            continue
        if tag in _VOID or self_closed(attributes):
            continue
        if tag in _SKIPPED:
            if ends is None:
                ends = ends_of(html)
            at = raw_end(html, tag, at) if tag in _RAW else head_end(html, at, ends) if tag == "head" else ends.get(hit.start(), at)
            continue
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in _IMPLIED.get(tag, ()) or tag in _SCOPES and stack[i][0] == "p":
                del stack[i:]
                break
            if stack[i][0] in _SCOPES:
                break
        zone = zone_of(tag, attributes, stack[-1][1])
        inherited = stack[-1][1]
        # What surrounds the main text stays so, whatever it holds, but for an article of its own;
        # a doubtful zone gives way to any that is not.
        now = inherited if zone is None or inherited < 0 and tag != "article" and inherited != DOUBTFUL else zone
        if tag in _INLINE and now != inherited:
            now = inherited if zone is None or zone > 0 else now
            if now != current:
                close()
        stack.append((tag, now))
        current = now
    close()
    return blocks


def describe(blocks: list[Block]) -> np.ndarray:
    """words, density, zone, and words and density of the blocks before and after."""
    words = np.array([0, *[b.words for b in blocks], 0], dtype=float)
    density = np.array([0, *[b.density for b in blocks], 0], dtype=float)
    zones = np.array([b.zone for b in blocks], dtype=float)
    return np.stack([words[1:-1], density[1:-1], zones, words[:-2], density[:-2], words[2:], density[2:]], axis=1)


# The labelled table: words, link density, zone, words and density before, words and density
# after, and whether the block is main text.
LABELLED = (
    (12, 0.0, 1, 1, 1.0, 80, 0.0, 1), (9, 0.0, 1, 6, 0.0, 120, 0.0, 1), (90, 0.0, 1, 12, 0.0, 70, 0.0, 1), (70, 0.05, 1, 90, 0.0, 45, 0.0, 1),
    (1, 0.0, 1, 60, 0.0, 40, 0.0, 1), (2, 0.0, 1, 44, 0.0, 0, 0.0, 1), (5, 0.0, 1, 70, 0.0, 12, 0.0, 1), (140, 0.1, 1, 3, 0.0, 9, 0.0, 1),
    (25, 0.3, 1, 60, 0.0, 30, 0.1, 1), (8, 0.5, 1, 60, 0.0, 50, 0.0, 1), (3, 0.0, 1, 0, 0.0, 0, 0.0, 1), (15, 0.0, 1, 14, 0.0, 16, 0.0, 1),
    (6, 1.0, 1, 40, 0.0, 40, 0.0, 1), (4, 1.0, 1, 5, 1.0, 5, 1.0, 0), (3, 1.0, 1, 4, 1.0, 60, 0.0, 0), (2, 1.0, 1, 3, 1.0, 2, 1.0, 0),
    (4, 0.0, 1, 5, 0.0, 1, 0.0, 1), (1, 0.0, 1, 1, 0.0, 1, 0.0, 1), (2, 0.0, 1, 3, 1.0, 4, 1.0, 1), (4, 0.2, 1, 2, 0.5, 3, 0.9, 1),
    (3, 0.0, 1, 11, 0.0, 7, 0.3, 1), (20, 0.4, 1, 8, 0.8, 5, 1.0, 1), (60, 0.0, 1, 30, 0.6, 40, 0.7, 1), (35, 0.0, 1, 1, 1.0, 1, 1.0, 1),
    (7, 0.0, 1, 200, 0.0, 9, 0.0, 1), (4, 0.0, 1, 4, 0.0, 4, 0.0, 1), (9, 0.0, 1, 9, 1.0, 9, 0.5, 1), (5, 0.6, 1, 60, 0.0, 12, 0.0, 1),
    (1, 1.0, -1, 1, 1.0, 1, 1.0, 0), (2, 1.0, -1, 0, 0.0, 1, 1.0, 0), (1, 1.0, -1, 2, 1.0, 9, 0.0, 0), (12, 0.0, -1, 1, 1.0, 10, 0.0, 0),
    (40, 0.0, -1, 3, 0.0, 30, 0.0, 0), (120, 0.0, -1, 80, 0.0, 90, 0.0, 0), (18, 0.0, -1, 60, 0.0, 0, 0.0, 0), (30, 0.1, -1, 20, 0.0, 25, 0.1, 0),
    (7, 0.0, -1, 90, 0.0, 4, 0.5, 0), (3, 0.3, -1, 2, 0.0, 3, 0.3, 0), (55, 0.0, -1, 1, 1.0, 60, 0.0, 0), (10, 0.2, -1, 40, 0.0, 0, 0.0, 0),
    (60, 0.0, 0, 45, 0.0, 80, 0.0, 1), (45, 0.02, 0, 8, 0.0, 60, 0.0, 1), (110, 0.1, 0, 1, 1.0, 30, 0.0, 1), (30, 0.0, 0, 70, 0.0, 25, 0.0, 1),
    (18, 0.0, 0, 60, 0.0, 50, 0.0, 1), (14, 0.0, 0, 40, 0.0, 35, 0.0, 1), (8, 0.0, 0, 3, 0.2, 90, 0.0, 1), (6, 0.0, 0, 50, 0.0, 60, 0.0, 1),
    (22, 0.0, 0, 12, 0.0, 28, 0.0, 1), (10, 0.0, 0, 0, 0.0, 0, 0.0, 1), (2, 0.0, 0, 0, 0.0, 0, 0.0, 1), (4, 0.0, 0, 0, 0.0, 0, 0.0, 1), (40, 0.0, 0, 0, 0.0, 0, 0.0, 1), (5, 0.0, 0, 0, 0.0, 35, 0.0, 1),
    (20, 0.0, 0, 20, 0.0, 2, 1.0, 1), (60, 0.0, 0, 50, 0.0, 3, 1.0, 1), (15, 0.0, 0, 30, 0.0, 2, 1.0, 1), (80, 0.0, 0, 4, 0.0, 1, 1.0, 1),
    (4, 1.0, 0, 3, 1.0, 2, 1.0, 0), (1, 1.0, 0, 1, 1.0, 1, 1.0, 0), (6, 0.8, 0, 4, 1.0, 70, 0.0, 0), (12, 0.9, 0, 9, 0.7, 11, 0.9, 0),
    (25, 0.8, 0, 20, 0.7, 30, 0.9, 0), (3, 0.0, 0, 2, 1.0, 3, 1.0, 0), (5, 0.0, 0, 4, 0.6, 2, 0.0, 0), (7, 0.4, 0, 3, 0.5, 5, 0.6, 0),
    (2, 0.0, 0, 3, 0.0, 1, 1.0, 0), (4, 0.0, 0, 2, 0.0, 3, 0.0, 0), (35, 0.6, 0, 5, 0.8, 8, 0.7, 0), (16, 0.7, 0, 60, 0.0, 4, 1.0, 0),
)

# The same for blocks of a doubtful zone, whose tree is grown by itself.
LABELLED_DOUBTFUL = (
    (60, 0.0, DOUBTFUL, 45, 0.0, 80, 0.0, 1), (45, 0.05, DOUBTFUL, 6, 0.0, 60, 0.0, 1), (120, 0.1, DOUBTFUL, 1, 1.0, 30, 0.0, 1), (35, 0.0, DOUBTFUL, 70, 0.0, 40, 0.0, 1),
    (80, 0.0, DOUBTFUL, 4, 0.0, 1, 1.0, 1), (25, 0.0, DOUBTFUL, 40, 0.0, 55, 0.0, 1), (30, 0.0, DOUBTFUL, 30, 0.0, 0, 0.0, 1), (22, 0.0, DOUBTFUL, 60, 0.0, 2, 1.0, 1),
    (9, 0.0, DOUBTFUL, 6, 0.0, 20, 0.0, 0), (4, 0.0, DOUBTFUL, 60, 0.0, 3, 1.0, 0), (12, 0.0, DOUBTFUL, 2, 1.0, 3, 1.0, 0), (2, 1.0, DOUBTFUL, 1, 1.0, 4, 1.0, 0),
    (25, 0.8, DOUBTFUL, 20, 0.7, 30, 0.9, 0), (40, 0.6, DOUBTFUL, 9, 0.7, 60, 0.0, 0), (1, 0.0, DOUBTFUL, 5, 0.3, 8, 0.0, 0),
    (14, 0.0, DOUBTFUL, 12, 0.0, 11, 0.0, 0), (18, 0.5, DOUBTFUL, 30, 0.0, 20, 0.0, 0),
)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6) -> tuple:
    """A binary decision tree by Gini impurity: (feature, limit, below, above) or (label,)."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return (bool(share >= 0.5),)
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for limit in (values[1:] + values[:-1]) / 2:
            below = rows[:, feature] <= limit
            impurity = sum(side.sum() * labels[side].mean() * (1 - labels[side].mean()) for side in (below, ~below))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, limit, below)
    if best is None:
        return (bool(share >= 0.5),)
    _, feature, limit, below = best
    return feature, float(limit), grow(rows[below], labels[below], depth - 1), grow(rows[~below], labels[~below], depth - 1)


@cache
def fitted() -> tuple:
    certain, doubtful = (grow(t[:, :-1], t[:, -1]) for t in (np.array(LABELLED, dtype=float), np.array(LABELLED_DOUBTFUL, dtype=float)))
    return 2, DOUBTFUL / 2, (2, (DOUBTFUL - 1) / 2, certain, doubtful), certain


def is_main(tree: tuple, row: np.ndarray) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def main_text(html: str | None, tree: tuple) -> str:
    """Main text of a page: its blocks joined by an empty line."""
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, row in zip(blocks, describe(blocks), strict=True) if is_main(tree, row))


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Put column ``out`` in the place of ``html``."""
    source = numbered(pages)
    position = pages.columns.index(html)
    fields = [f for i, f in enumerate(source.schema.fields) if i != position]
    schema = T.StructType([*fields, T.StructField("text", T.StringType())])
    tree = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                texts = pa.array([main_text(h, tree) for h in part.column(position).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(part.columns) if i != position], texts], names=schema.fieldNames())

    return given_back(source.mapInArrow(run, schema), pages.columns, {out: "text"}, [html])
