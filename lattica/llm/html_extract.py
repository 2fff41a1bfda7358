"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with its path from the root: the block-level tags with their class names. Per
path, text length, punctuation and linked text are summed and divided by the number of its blocks. The two ratios are smoothed
over the neighbouring blocks in page order, fused by their geometric mean and lowered by the share of linked text. Paths whose
fused ratio reaches ``CONTENT`` of the largest (or the mean less one deviation, if that is more) are content paths.

1. The content node is the element that holds most of the content paths' text: an ``article`` or ``main`` if one holds half of
   it, else the deepest that holds four fifths.
2. Inside it a block stays if its path is a content path or if it stands beside blocks of content paths (headings, short
   paragraphs, lists). A container without any content path goes if half of its text is linked, or if it is a ``div`` or the
   like before the first or behind the last content block and all its ratios are under ``PART`` of the largest.
3. Menus, footers, sidebars, forms, scripts and the like go by tag or role, as the HTML standard names them. Names of classes
   and ids are hints: names of reader comments and adverts count anywhere; words that can mean something else (``MAYBE``) count
   inside an article only for a container without content paths. A name counts only if all its words are known, so
   ``with-sidebar`` isn't one, and no name counts for an element that holds an ``article``, ``main`` or ``h1``.

Defined cases: null and empty pages, and pages without content text, give an empty string; pages of any length are read whole;
an empty table gives an empty result; unclosed, crossed and truncated tags are repaired as browsers do for paragraphs, list
items and table cells; a script or another raw element ends at its own end tag, whatever stands in it, or with the page;
unknown character references stay as they are; a quote opens a value only behind ``=``; elements nested more than 512 deep become
siblings; text outside any element is a block of its own; repeated rows are extracted
alike; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm._text import bounded_batches, lean

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟،]")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NUMBER = re.compile(r"[0-9]+")
# Names from the HTML standard.
RAW = frozenset("script style noscript template iframe svg canvas object math title textarea select audio video".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head nav footer aside form menu dialog button label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt tr td th tbody thead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STOPS = frozenset("article section div table ul ol dl body main blockquote aside nav footer header form".split())


# Our own choice of words for parts of a page in names of classes and ids.
COMMENTS = frozenset("comment comments commentlist disqus replies respond reactions".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion newsletter subscribe subscription signup breadcrumb breadcrumbs pagination pager related recommended recommendations".split())
MAYBE = frozenset("nav navbar navigation menu submenu sidebar aside footer header masthead topbar toolbar banner cookie cookies consent gdpr notice notices alert popup modal overlay login share sharing social widget widgets skip hidden copyright".split())
#: Words that say nothing about what a part is.
PLAIN = frozenset("a the box block wrap wrapper container inner outer list item items area section bar slot top bottom left right primary secondary global site js new form link links post posts button buttons thread main".split())
CONTAINERS = frozenset("div section article main ul ol dl table figure details center td".split())
GENERIC = frozenset("div section article main center td".split())
CONTENT, PART, LINKED = 0.5, 0.25, 0.5
#: Elements that are nested deeper become siblings, as in browsers.
DEEPEST = 512


class _Node:
    """``path`` is a number for the tags and names of all block elements down to this one, ``depth`` how many they are."""

    __slots__ = ("tag", "parent", "path", "paths", "depth", "off", "length", "hint", "within", "holds_title", "linked")

    def __init__(self, tag: str, parent: _Node | None, off: bool = False, names: tuple[str, ...] = (), hint: int = 0):
        self.tag, self.parent, self.off, self.hint, self.length, self.holds_title = tag, parent, off, hint, 0.0, False
        self.paths: dict[tuple[int, str], int] = parent.paths if parent else {}
        above = parent.path if parent else 0
        self.path, self.depth = above, parent.depth if parent else 0
        if tag and tag not in INLINE:
            self.path, self.depth = self.paths.setdefault((above, ".".join((tag, *names))), len(self.paths) + 1), self.depth + 1
        self.linked = tag == "a" or parent is not None and parent.linked
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main"))


def _hint(name: str) -> int:
    """What a class name or id says: 0 nothing, 1 perhaps a part of the page, 2 an advert or the like, 3 reader comments."""
    words = set(_WORD.findall(_CAMEL.sub(" ", name).lower()))
    if not words or not words <= COMMENTS | ADVERTS | MAYBE | PLAIN:
        return 0
    return 3 if words & COMMENTS else 2 if words & ADVERTS else 2 if len(words & MAYBE) > 1 else 1 if words & MAYBE else 0


def _element(tag: str, attributes: str, parent: _Node) -> _Node:
    if parent.off or tag in NEVER or tag == "header" and not parent.within and parent.tag not in ("article", "main"):
        return _Node(tag, parent, True)
    if not attributes.strip():
        return _Node(tag, parent)
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    classes = found.get("class", "").split()
    names = tuple(sorted({_NUMBER.sub("", c) for c in classes}))
    if tag in ("html", "body", "article", "main"):
        return _Node(tag, parent, False, names)
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", found.get("style", "")):
        return _Node(tag, parent, True)
    hints = [_hint(c) for c in classes]
    other = any(h == 0 and not set(_WORD.findall(_CAMEL.sub(" ", c).lower())) <= PLAIN for c, h in zip(classes, hints, strict=True))
    hint = max([*hints, _hint(found.get("id", ""))], default=0)
    return _Node(tag, parent, False, names, 0 if hint == 1 and other else hint)


Block = tuple[_Node, str, float]


def text_blocks(page: str) -> list[Block]:
    """Blocks of text in page order: the block element that holds each, its text, and the share of it that is linked.

    Parts that never count by tag or role are left out.
    """
    root = _Node("", None)
    stack, out, pending, linked = [root], [], [], [0]

    def holder() -> _Node:
        node = stack[-1]
        while node.tag in INLINE:
            node = node.parent
        return node

    def flush() -> None:
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            if text:
                out.append((holder(), text, min(1.0, linked[0] / len(text))))
            pending.clear()
            linked[0] = 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1].tag not in INLINE:
                flush()
            stack.pop()

    at = 0
    while m := _TOKEN.match(page, at):
        at, tag = m.end(), m[2]
        if tag is None:
            if not m[0].startswith(("<!", "<?")) and not stack[-1].off:
                pending.append(m[0])
                if stack[-1].linked:
                    linked[0] += len(m[0].strip())
            elif m[0].startswith("<![CDATA[") and not stack[-1].off:
                pending.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img") and not stack[-1].off:
                if tag == "hr":
                    flush()
                pending.append(" ")
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    pop_to(depth)
                    break
                if stack[depth].tag in STOPS:
                    break
        if tag in CLOSED_BY:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in CLOSED_BY[tag]:
                    pop_to(depth)
                    break
                if stack[depth].tag in STOPS:
                    break
        if tag not in INLINE:
            flush()
        if len(stack) > DEEPEST:
            pop_to(DEEPEST)
        stack.append(_element(tag, m[3], stack[-1]))
        if tag in ("article", "main", "h1") and not stack[-1].off:
            node = stack[-1].parent
            while node is not None and not node.holds_title:
                node.holds_title = True
                node = node.parent
    pop_to(1)
    flush()
    return out


def path_ratios(blocks: list[Block]) -> tuple[list[float], list[float]]:
    """The smoothed and fused ratio of each block's path, and the same without smoothing."""
    length: dict[int, float] = defaultdict(float)
    marks: dict[int, float] = defaultdict(float)
    links: dict[int, float] = defaultdict(float)
    number: dict[int, int] = defaultdict(int)
    for node, text, linked in blocks:
        length[node.path] += len(text)
        marks[node.path] += len(_PUNCTUATION.findall(text))
        links[node.path] += linked * len(text)
        number[node.path] += 1
    lengths, punctuation = ([total[n.path] / number[n.path] for n, _, _ in blocks] for total in (length, marks))
    free = [1 - links[n.path] / length[n.path] for n, _, _ in blocks]

    def smooth(x: list[float]) -> list[float]:
        return [0.25 * x[max(i - 1, 0)] + 0.5 * v + 0.25 * x[min(i + 1, len(x) - 1)] for i, v in enumerate(x)]

    def fuse(a: list[float], b: list[float]) -> list[float]:
        return [((x + 1) * (y + 1)) ** 0.5 * f for x, y, f in zip(a, b, free, strict=True)]

    return fuse(smooth(lengths), smooth(punctuation)), fuse(lengths, punctuation)


def _up(node: _Node | None, top: _Node | None = None) -> Iterator[_Node]:
    """A node and those around it, up to but without ``top``."""
    while node is not None and node is not top:
        yield node
        node = node.parent


def _named_part(node: _Node) -> bool:
    """Whether names of classes or ids put a block into a part of the page that isn't the article."""
    return any(not x.holds_title and (x.hint >= 2 or x.hint == 1 and not x.within) for x in _up(node))


def _content_node(blocks: list[Block], content: set[int]) -> _Node | None:
    """The element that holds most of the text of the content paths."""
    total = 0
    for node, text, _ in blocks:
        if node.path in content:
            total += len(text)
            for x in _up(node):
                x.length += len(text)
    best = None
    for node, _, _ in blocks:
        for x in _up(node):
            rank = (x.tag == "article" and x.length >= 0.5 * total, x.tag == "main" and x.length >= 0.5 * total, x.length >= 0.8 * total, x.depth)
            if x.length >= 0.5 * total and (best is None or rank > best[0]):
                best = rank, x
    top = best[1] if best else None
    while top is not None and top.tag in HEADINGS | {"p", "li", "pre", "blockquote", "td"} and top.parent is not None:
        top = top.parent  # a lone block: its neighbours belong to it
    return top


def main_text(page: str | None) -> str:
    """The main text of a page: blocks joined by one space."""
    found = [b for b in text_blocks(page or "") if not _named_part(b[0])]
    if not found:
        return ""
    smoothed, own = path_ratios(found)
    mean = sum(smoothed) / len(smoothed)
    spread = (sum((r - mean) ** 2 for r in smoothed) / len(smoothed)) ** 0.5
    content = {n.path for (n, _, _), r in zip(found, smoothed, strict=True) if r >= max(mean - spread, CONTENT * max(smoothed))}
    top = _content_node(found, content)
    inside = [(*b, r) for b, r in zip(found, own, strict=True) if top is None or any(x is top for x in _up(b[0]))]
    placed = [i for i, (node, _, _, _) in enumerate(inside) if node.path in content]
    if not placed:
        return " ".join(text for _, text, _, _ in inside)
    kept_in = {id(x) for i in placed for x in _up(inside[i][0], top)}
    # the outermost container of each block that holds no content path: what is decided about as a whole
    parts: dict[int, list[int]] = defaultdict(list)
    hinted: set[int] = set()
    for i, (node, _, _, _) in enumerate(inside):
        outer = [x for x in _up(node, top) if x.tag in CONTAINERS and id(x) not in kept_in]
        if outer:
            parts[id(outer[-1])].append(i)
            if any(x.hint for x in outer):
                hinted.add(id(outer[-1]))
    gone: set[int] = set()
    generic = {id(x) for node, _, _, _ in inside for x in _up(node, top) if x.tag in GENERIC}
    for part, own_blocks in parts.items():
        size = sum(len(inside[i][1]) for i in own_blocks)
        linked = sum(len(inside[i][1]) * inside[i][2] for i in own_blocks)
        at_edge = own_blocks[-1] < placed[0] or own_blocks[0] > placed[-1]
        weak = max(inside[i][3] for i in own_blocks) < PART * max(own) and not any(inside[i][0].tag == "h1" for i in own_blocks)
        if linked >= LINKED * size or part in hinted or part in generic and at_edge and weak:
            gone.update(own_blocks)
    return " ".join(text for i, (_, text, _, _) in enumerate(inside) if i not in gone)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; each page is read on its own, so there is no shuffle."""
    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(lean(_run), "page_id long, url string, text string, n_chars long")
