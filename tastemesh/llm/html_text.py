"""Main text of web pages by consensus of a host's pages.

Each page proposes containers: for every block element its own text, less what lies in boilerplate (by tag, by words
of its class, id or role) or in links, is scored, and the best container votes for its generalised path: tags and
classes from the root, numbers replaced by ``#``. The best is the tightest one around the text, widened to the article or
main that it is part of and to elements around with text of the same flow, such as a title or lead. Votes are summed by host in Spark, and each page is cut again along
its host's winning path; a page without that path uses its own best container. A hot host only means larger
sums: votes are combined before the shuffle, and winners, one row a host, are joined to the pages.

Inside a container the text of blocks is kept in page order; boilerplate elements are left out, but not headings of an
article, nor elements around the article or most of the page's text. Words mark an element only as a whole class
token, role or id. White space inside a block becomes one space; blocks are joined by one space.

Edge cases: null or empty html gives an empty text; text outside any element counts as the body's; unclosed, stray
and overlapping tags, quoted ``>``, comments, CDATA and raw text elements are handled; pages of a null or unparsable
url vote as one host; equal rows each get a row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator, Set

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemesh.llm.tables import Batches, ids
from tastemesh.llm.words import chunks
from tastemesh.sources.staging import stage

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "center",
}
LEFT_OUT = {"nav", "header", "footer", "aside", "form", "menu", "head", "button", "select", "dialog", "svg", "canvas", "audio", "video", "object", "map", *RAW}
_AROUND = {"form"}  # of these, those that are found around whole pages
CONTAINERS = {"html", "body", "article", "main", "section", "div", "td", "center", "content"}
_LEFT_OUT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "menu", "nav",
    "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal",
    "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "reply", "replies",
    "disqus", "widget", "search", "toolbar", "pagination", "pager", "copyright", "skip", "hidden", "contentinfo", "complementary",
}
# Words that may stand beside those in a class token or id without changing what it is.
_NEUTRAL_WORDS = {
    "slot", "box", "bar", "block", "area", "wrap", "wrapper", "container", "inner", "outer", "holder", "panel", "section", "region", "zone", "unit", "group",
    "list", "item", "items", "link", "links", "button", "buttons", "btn", "icon", "icons", "form", "field", "input", "toggle", "trigger", "title", "heading",
    "text", "body", "thread", "respond", "count", "posts", "post", "entry", "article", "articles", "story", "stories", "site", "page", "main", "global",
    "primary", "secondary", "top", "bottom", "left", "right", "col", "column", "row", "x", "google", "dfp", "media", "overlay", "message", "tabs", "trail", "default",
}
# Things apart from the article, which may be longer than it is; no layout wraps the article in one of them.
_APART_WORDS = {
    "comment", "comments", "reply", "replies", "disqus", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "copyright", "related", "recommended", "newsletter",
}
_TITLED = {"post", "entry", "article", "story"}  # their headers hold titles
_LONG_PATH = 400
_NO_BREAK = {"img", "input", "wbr", "embed", "svg", "canvas", "button", "select"}
_KEEPS = {"body", "html", "article", "main"}  # words of their class describe the page, not the element
_CLOSES_P = re.compile("^(?:address|article|aside|blockquote|div|dl|fieldset|footer|form|h[1-6]|header|hr|main|nav|ol|p|pre|section|table|ul)$")
_CLOSED_BY_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WHOLE = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_SCOPES = {"ul", "ol", "dl", "table", "td", "th", "div", "article", "section", "body", "html", "main", "aside", "nav"}


class _Node:
    """An open element: its generalised path, the element around it, and what it inherits."""

    __slots__ = ("tag", "path", "parent", "skip", "link", "article", "inside", "number", "mark")

    def __init__(self, tag: str, path: str, parent: _Node | None, number: int, mark: int = 0, kept: bool = False, wanted: str | None = None):
        self.tag, self.path, self.parent, self.number, self.mark = tag, path, parent, number, mark
        self.skip = (mark > 0 and not kept) or (parent is not None and parent.skip)
        self.link = tag == "a" or (parent is not None and parent.link)
        self.article = tag == "article" or (parent is not None and parent.article)
        self.inside = (parent is not None and parent.inside) or (tag not in INLINE and path == wanted)


def _named(tokens: list[str], article: bool) -> int:
    """The mark of class tokens, roles or an id: 0 for none, 2 for things apart from any article, else 1."""
    mark = 0
    for token in tokens:
        words = set(re.split("[^a-z]+", token)) - {""}
        named = words & _LEFT_OUT_WORDS
        if article or not _TITLED.isdisjoint(words):
            named -= {"header"}
        if named and words <= _LEFT_OUT_WORDS | _NEUTRAL_WORDS:
            mark = max(mark, 1 if named.isdisjoint(_APART_WORDS) else 2)
    return mark


def _step(tag: str, attributes: str, article: bool) -> tuple[str, int]:
    """The path step of an element, and the mark its attributes give it as boilerplate.

    A token counts as a whole, so ``with-sidebar`` or ``no-comments`` say nothing. Ids of headings, and of sections
    of an article, are made from their titles and say nothing either.
    """
    if not attributes.strip(" /\n\t"):
        return tag, 0
    step, mark = tag, 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape("".join(values)).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            mark = max(mark, 1)
        elif name == "style":
            mark = max(mark, int("display:none" in value.replace(" ", "")))
        elif name in ("class", "id", "role"):
            slug = name == "id" and (tag in _HEADINGS or (tag == "section" and article))
            if tag not in _KEEPS and not slug:
                mark = max(mark, _named(value.split(), article))
            if name == "class":
                step += "".join(f".{c}" for c in sorted(set(re.sub("[0-9]+", "#", value).split())))
    return step, mark


def page_pieces(source: str, wanted: str | None = None) -> list[tuple[_Node, str, bool]]:
    """The pieces of ``page_blocks``, where marked elements that hold the article or most of the text are not skipped."""
    pieces = list(page_blocks(source, wanted))
    kept = _wrappers(pieces)
    return list(page_blocks(source, wanted, kept)) if kept else pieces


def _wrappers(pieces: list[tuple[_Node, str, bool]]) -> set[int]:
    """Numbers of the marked elements around the article or around most of the text outside links."""
    nodes: dict[int, _Node] = {}
    words: dict[int, int] = {}
    for node, text, _ in pieces:
        if not node.link:
            words[node.number] = words.get(node.number, 0) + len(text.split())
        while node is not None and node.number not in nodes:
            nodes[node.number] = node
            node = node.parent
    order = sorted(nodes)  # outer elements first
    if not any(nodes[n].mark for n in order):
        return set()
    nearest: dict[int, int] = {}  # the innermost marked element around, -1 for none
    shown: dict[int, int] = {}  # words by that element
    total = dict.fromkeys(order, 0) | words
    for n in order:
        node = nodes[n]
        nearest[n] = n if node.mark else nearest[node.parent.number] if node.parent else -1
        shown[nearest[n]] = shown.get(nearest[n], 0) + words.get(n, 0)
    for n in reversed(order):
        if nodes[n].parent:
            total[nodes[n].parent.number] += total[n]
    article = max((n for n in order if nodes[n].tag in _WHOLE and total[n]), key=lambda n: (total[n], -n), default=None)
    around, node = set(), nodes.get(article)
    while node is not None:
        around.add(node.number)
        node = node.parent
    kept, left = {-1}, shown.get(-1, 0)
    for level in (1, 2):  # things apart only around an article, and where nothing else is left of the page
        for n in order:
            node = nodes[n]
            if node.mark not in range(1, level + 1) or n in kept or (node.parent and nearest[node.parent.number] not in kept):
                continue
            most = node.mark == 1 and 2 * total[n] > total[order[0]] and total[n] > 4 * left
            if most or (n in around and total[article] > left and (node.mark == 1 or not left)):
                kept.add(n)
                left += shown.get(n, 0)
    kept.discard(-1)
    return kept


def page_blocks(source: str, wanted: str | None = None, kept: Set[int] = frozenset()) -> Iterator[tuple[_Node, str, bool]]:
    """Pieces of text in page order with the element around them, and whether a block starts before the piece.

    Elements on the path ``wanted`` and below are ``inside``; marked ones whose number is in ``kept`` are not skipped.
    """
    open_, at, count, fresh = [_Node("html", "html", None, 0, wanted=wanted)], 0, 1, True
    while at < len(source):
        found = _TAG.search(source, at)
        end = found.start() if found else len(source)
        if end > at:
            yield open_[-1], source[at:end], fresh
            fresh = False
        if not found:
            break
        at = found.end()
        closing, tag, attributes = found.group(1), (found.group(2) or "").lower(), found.group(3) or ""
        if not tag or tag == "html" or (tag == "body" and len(open_) > 1 and open_[1].tag == "body" and not closing):
            continue
        fresh |= tag not in INLINE and tag not in RAW and tag not in _NO_BREAK
        if closing:
            depth = next((d for d in range(len(open_) - 1, 0, -1) if open_[d].tag == tag), 0)
            # A formatting tag left open inside a block does not outlive it, nor close the block from within.
            if depth and not (tag in INLINE and any(n.tag not in INLINE for n in open_[depth + 1 :])):
                del open_[depth:]
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
            at = close.end() if close else len(source)
            continue
        if _CLOSES_P.match(tag):
            _close(open_, {"p"})
        if tag in _CLOSED_BY_LIKE:
            _close(open_, _CLOSED_BY_LIKE[tag])
        if tag in VOID or (attributes.endswith("/") and tag in ("svg", "path", "circle", "rect", "use")):
            continue
        above = open_[-1]
        step, mark = _step(tag, attributes, above.article)
        if tag in LEFT_OUT and not (tag == "header" and above.article):
            mark = max(mark, 1 if tag in _AROUND else 2)
        path = above.path if tag in INLINE else f"{above.path}>{step}"
        if len(path) > _LONG_PATH:  # deep pages keep short names
            path = "~" + hashlib.blake2b(path.encode(), digest_size=16).hexdigest()
        open_.append(_Node(tag, path, above, count, mark, count in kept, wanted))
        count += 1


def _close(open_: list[_Node], tags: set[str]) -> None:
    """End the nearest element of ``tags`` unless a scope lies between."""
    for depth in range(len(open_) - 1, 0, -1):
        if open_[depth].tag in tags:
            del open_[depth:]
            return
        if open_[depth].tag in _SCOPES:
            return


def best_container(source: str) -> str | None:
    """The path of the container that holds most text of its own, deep ones first on near ties, widened."""
    scores: dict[int, list] = {}
    pieces = page_pieces(source)
    for node, text, _ in pieces:
        size = len(text.split())
        if not size or node.skip:
            continue
        gain = -size if node.link else size
        # Text passes on to outer containers with a loss, so the tightest one around the text wins.
        while node is not None and abs(gain) > size / 100:
            if node.tag in CONTAINERS:
                entry = scores.setdefault(node.number, [0.0, node])
                entry[0] += gain
                gain *= 0.8
            node = node.parent
    best = max(scores.items(), key=lambda x: (x[1][0], x[0]), default=None)
    return _widened(best[1][1], pieces).path if best and best[1][0] > 0 else None


def _widened(tight: _Node, pieces: list[tuple[_Node, str, bool]]) -> _Node:
    """The nearest article or main around the tightest container, and further out while text of the same flow is there.

    An element around it is of the same flow if it holds text itself (or in its sections, not in other containers),
    of the body only if that has a heading, and if what it adds is more text than links.
    """
    out = tight
    while out.parent is not None and out.tag not in _WHOLE:
        out = out.parent
    out = out if out.tag in _WHOLE else tight
    around, node = {}, tight
    while node is not None:
        around[node.number] = len(around)
        node = node.parent
    added = [[0, 0] for _ in around]  # words and words of links, by the innermost element around them
    flow, titled = [0] * len(around), [False] * len(around)
    place: dict[int, tuple[int, bool, bool]] = {}

    def placed(node: _Node) -> tuple[int, bool, bool]:
        """The innermost element around, whether no other container lies between, and whether it is in a heading."""
        way = []
        while node.number not in place and node.number not in around:
            way.append(node)
            node = node.parent
        at, direct, heading = place.get(node.number) or (around[node.number], True, False)
        for node in reversed(way):
            direct, heading = direct and (node.tag not in CONTAINERS or node.tag == "section"), heading or node.tag in _HEADINGS
            place[node.number] = at, direct, heading
        return at, direct, heading

    for node, text, _ in pieces:
        size = len(text.split())
        if size and not node.skip:
            at, direct, heading = placed(node)
            added[at][node.link] += size
            if direct and not node.link:
                flow[at] += size
                titled[at] |= heading
    node, words, links, own, title = out, 0, 0, 0, False
    for at in range(around[out.number] + 1, len(around)):
        node = node.parent
        words, links = words + added[at][0], links + added[at][1]
        own, title = own + flow[at], title or titled[at]  # text in a section or list around belongs to what is around that
        if node.tag in CONTAINERS and node.tag != "section":
            if words > links and (title if node.tag in ("body", "html") else own):
                out, words, links = node, 0, 0
            own, title = 0, False
    return out


def main_text(source: str, path: str) -> str:
    """Text of all elements on the path, boilerplate left out; blocks joined by one space."""
    blocks: list[str] = []
    parts: list[str] = []
    for node, text, fresh in page_pieces(source, path):
        if fresh and parts:
            blocks.append("".join(parts))
            parts = []
        if node.inside and not node.skip:
            parts.append(html.unescape(text))
    blocks.append("".join(parts))
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def _host(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """``host``, ``path`` and how many pages of the host chose it."""

    def vote(batches: Batches) -> Batches:
        for batch in batches:
            for piece in chunks(batch, "html"):
                paths = [best_container(x.as_py()) if x.is_valid else None for x in piece.column("html")]
                yield pa.RecordBatch.from_arrays([piece.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    chosen = pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string")
    return chosen.where("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("pages"))


def winners(pages: DataFrame) -> DataFrame:
    """``host`` and its winning ``path``; ties go to the longer path, then the greater text."""
    best = F.max(F.struct("pages", F.length("path").alias("length"), "path")).alias("best")
    return votes(pages).groupBy("host").agg(best).select("host", "best.path")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and the ``path`` used."""

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            for piece in chunks(batch, "html"):
                texts, used = [], []
                for source, path in zip(piece.column("html"), piece.column("path").to_pylist(), strict=True):
                    source = source.as_py() or ""
                    text = main_text(source, path) if path else ""
                    if not text:
                        path = best_container(source)
                        text = main_text(source, path) if path else ""
                    texts.append(text)
                    used.append(path)
                yield pa.RecordBatch.from_arrays(
                    [ids(piece, "page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array(used, pa.string())],
                    ["page_id", "url", "text", "path"])

    agreed = stage(winners(pages), "host-paths")  # its size is known, so Spark broadcasts it only if small
    named = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host")).join(agreed, "host", "left")
    return named.select("page_id", "url", "html", "path").mapInArrow(cut, "page_id long, url string, text string, path string")
