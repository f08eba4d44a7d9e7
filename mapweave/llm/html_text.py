"""Main text of web pages by scoring the element tree.

Each stretch of text in a block passes points for its length and commas to its
ancestors, most to the nearest. A container's points are discounted by the share
of its text inside links. The best container, widened to the article or main
element around it, is kept with those siblings that look like more of the same.
Elements that are never article text (menus, forms, scripts, and those whose
class, id or role says advert, notice, comment and so on) are left out before,
unless their content says otherwise: a form or fieldset around most of the page's
prose, a menu or sidebar that is never closed and so runs over the article, and a
marked element with nearly all of the prose that is not about readers' comments.

Defined cases: null or empty html gives an empty text and 0 characters; pages
without any marked-up block use the body text; repeated rows stay repeated;
unclosed and stray tags are tolerated; depth is not limited.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
NEVER_TEXT = frozenset(
    "aside audio button canvas dialog fieldset footer form head iframe input legend map menu nav noscript object option "
    "script select style svg template textarea title video".split())
KEPT_ROOTS = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words of class, id and role values that mark what is not article text.
BOILERPLATE = frozenset(
    "ad ads adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "commentlist complementary contentinfo cookie cookies consent disqus feedback footer footnav gdpr header masthead "
    "menu modal nav navbar navigation navigator newsletter notice notices notification outbrain overlay pager "
    "pagination popup promo promoted recommend recommended related replies reply respond search share sharing "
    "shoutbox sidebar sidenav signup skyscraper social sponsor sponsored subscribe taboola toolbar topbar widget".split())

#: Words that name content, and words that make a mark of the page's features of a boilerplate word.
CONTENT = frozenset("article body content entry main page post story text".split())
MODIFIERS = frozenset("closed enabled has no open with without".split())

#: Words of readers' remarks, which can hold most of a page's text.
REMARKS = frozenset("comment comments commentlist disqus feedback replies reply respond shoutbox".split())

#: Elements that may stand around an article: whole pages in a form, and menus whose end is missing.
WRAPPERS = frozenset("form fieldset".split())
UNCLOSED = frozenset("aside nav".split())

#: A paragraph of prose has at least this many characters.
PROSE = 80

#: Ancestors that get points from a block: half as many for each further one.
REACH = 20

_PART = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CLOSES_P = NEVER_TEXT | HEADINGS | frozenset(
    "address article blockquote center dd details div dl dt figure figcaption header hr li main ol p pre section table "
    "ul".split())
_SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table tbody thead tfoot select body article section div main".split())


class Node:
    __slots__ = ("tag", "marks", "parent", "parts", "points", "length", "linked", "main", "closed", "menu")

    def __init__(self, tag: str, marks: str, parent: Node | None) -> None:
        self.tag, self.marks, self.parent = tag, marks, parent
        self.parts: list = []
        self.points = 0.0
        self.length = self.linked = 0
        self.main = self.closed = self.menu = False

    def is_boilerplate(self) -> bool:
        if self.menu:
            return True
        if self.main and self.tag in WRAPPERS | UNCLOSED:
            return False
        if self.tag in NEVER_TEXT:
            return True
        if self.tag == "header":
            return not _within(self.parent, "article")
        if self.main or self.tag in KEPT_ROOTS and self.tag != "article" or not self.marks:
            return False
        return not BOILERPLATE.isdisjoint(_PART.split(self.marks))


def _mark_main(root: Node) -> None:
    """Exempt from their marks the containers with over half of the unlinked text of the page.

    Text of marked elements inside them does not count, and their marks must name
    content as well or only say what the page has: comments alone can be long.
    Other marks are overruled by nine tenths of the text. Forms and menus that
    were never closed are exempt if most of the prose stands in them.
    """
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(p for p in node.parts if isinstance(p, Node) and (
            p.tag not in NEVER_TEXT or p.tag in WRAPPERS or p.tag in UNCLOSED and not p.closed))
    clean, size, prose, linked = {}, {}, {}, {}
    for node in reversed(nodes):
        texts = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        below = [p for p in node.parts if id(p) in size]
        size[id(node)] = 0 if node.tag == "a" else texts + sum(size[id(p)] for p in below)
        clean[id(node)] = 0 if node.tag == "a" else texts + sum(
            clean[id(p)] for p in below if not p.is_boilerplate() or p.tag in WRAPPERS | UNCLOSED)
        linked[id(node)] = sum(linked[id(p)] for p in below) + (texts if node.tag == "a" else 0)
        own = size[id(node)] if node.tag == "p" else texts
        inside = 0 if node.tag == "p" else sum(prose[id(p)] for p in below if p.tag not in INLINE)
        prose[id(node)] = inside + (own if own >= PROSE else 0)
    whole = max(size[id(root)], 1)
    for node in nodes:
        if not node.is_boilerplate() or node.tag == "header":
            continue
        if node.tag in WRAPPERS | UNCLOSED:
            node.main = clean[id(node)] > 0.5 * whole and prose[id(node)] > 0.5 * prose[id(root)] > 0
            if node.main and node.tag in UNCLOSED:
                # What the menu itself held: links, and lists and other parts that are mostly links.
                for part in node.parts:
                    if id(part) in size:
                        part.menu = part.tag == "a" or linked[id(part)] > size[id(part)]
            elif node.main:
                _mark_labels(node)
        elif node.tag not in NEVER_TEXT:
            node.main = clean[id(node)] > 0.5 * whole and _names_content(node.marks) or (
                clean[id(node)] > 0.9 * whole and REMARKS.isdisjoint(_PART.split(node.marks)) and prose[id(node)] > 0)


def _mark_labels(form: Node) -> None:
    stack = [form]
    while stack:
        node = stack.pop()
        node.menu = node.tag == "label"
        stack.extend(p for p in node.parts if isinstance(p, Node))


def _names_content(marks: str) -> bool:
    """A mark of content words only, or marks like has-sidebar and comments-open only."""
    plain = [words for m in marks.split() if MODIFIERS.isdisjoint(words := _PART.split(m))]
    return not any(not BOILERPLATE.isdisjoint(w) for w in plain) or any(
        BOILERPLATE.isdisjoint(w) and not CONTENT.isdisjoint(w) for w in plain)


def _within(node: Node | None, tag: str) -> bool:
    while node:
        if node.tag == tag:
            return True
        node = node.parent
    return False


class TreeBuilder(HTMLParser):
    """Element tree with the end tags that HTML implies."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", "", None)
        self.open: dict[str, int] = {}

    def _close(self, node: Node) -> None:
        """Close the open elements down to ``node``, itself included."""
        while True:
            top = self.at
            self.open[top.tag] -= 1
            self.at = top.parent
            if top is node:
                return

    def _close_in_scope(self, tags, scopes) -> None:
        node = self.at
        if not any(self.open.get(t) for t in tags):
            return
        while node.parent and node.tag not in scopes:
            if node.tag in tags:
                self._close(node)
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _CLOSES_P:
            self._close_in_scope({"p"}, _SCOPES | {"td", "th", "button"})
        if tag in _SAME_CLOSES:
            self._close_in_scope(_SAME_CLOSES[tag], _SCOPES - {"div", "section"})
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower()
        node = Node("template" if hidden else tag, marks, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.open[node.tag] = self.open.get(node.tag, 0) + 1
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        node.closed = True
        self._close(node)

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def _steps(root: Node) -> Iterator[tuple[object, bool]]:
    """Nodes (entered, left) and texts of a tree in page order, without boilerplate."""
    stack: list = [(root, True)]
    while stack:
        item, entered = stack.pop()
        yield item, entered
        if entered and isinstance(item, Node):
            stack.append((item, False))
            stack.extend((p, True) for p in reversed(item.parts) if not (isinstance(p, Node) and p.is_boilerplate()))


def _blocks(root: Node) -> Iterator[tuple[Node, str, int]]:
    """(block element, text, linked characters) of each stretch of inline text."""
    pieces: list[str] = []
    block, links, linked = root, 0, 0
    for item, entered in _steps(root):
        if isinstance(item, str):
            pieces.append(item)
            linked += len(item.strip()) if links else 0
        elif item.tag in INLINE:
            links += (1 if entered else -1) * (item.tag == "a")
            if item.tag == "br" and entered:
                pieces.append(" ")
        else:
            if text := " ".join("".join(pieces).split()):
                yield block, text, linked
            pieces, linked = [], 0
            block = item if entered else item.parent or item
    if text := " ".join("".join(pieces).split()):
        yield block, text, linked


def _score(root: Node) -> Node | None:
    """Give points to the ancestors of each block; the best container."""
    touched: dict[int, Node] = {}
    for block, text, linked in _blocks(root):
        density = min(linked / len(text), 1.0)
        points = (min(len(text) / 100, 3.0) + text.count(",") + (block.tag not in HEADINGS)) * (1 - density)
        inner = block.tag in ("p", "pre", "li", "blockquote") or block.tag in HEADINGS
        node, depth = (block.parent if inner else None) or block, 0
        while node and depth < REACH:
            touched[id(node)] = node
            node.points += points / 2 ** depth
            node.length += len(text)
            node.linked += linked
            node, depth = node.parent, depth + 1
    best = None
    for node in touched.values():
        value = node.points * (1 - min(node.linked / max(node.length, 1), 1.0))
        node.points = value
        if node.tag not in ("#root", "html") and (best is None or value > best.points):
            best = node
    return best or (root if touched else None)


def _kept(best: Node) -> list[Node]:
    """The container, widened to its article, and siblings that go with it."""
    for tag in ("article", "main"):
        node = best
        while node and node.tag != tag:
            node = node.parent
        if node:
            best = node
            break
    if not best.parent or best.tag == "body":
        return [best]
    out = []
    # Beside an article or main only more of the same; else any block that is not mostly links, and bare text.
    beside = best.tag not in ("article", "main")
    for part in _with_bare_text(best.parent) if beside else best.parent.parts:
        if part is best:
            out.append(part)
        elif isinstance(part, Node) and not part.is_boilerplate():
            texts = list(_blocks(part))
            size = sum(len(t) for _, t, _ in texts)
            dense = sum(n for *_, n in texts) / max(size, 1)
            alike = part.tag == best.tag and part.marks == best.marks and part.points >= 0.2 * best.points
            if size and dense < 0.5 and (alike or beside and part.tag not in INLINE):
                out.append(part)
    return out


def _with_bare_text(parent: Node) -> list[Node]:
    """The parts of an element, with each stretch of text and inline elements between blocks as one part."""
    out: list[Node] = []
    for part in parent.parts:
        if isinstance(part, Node) and part.tag not in INLINE:
            out.append(part)
            continue
        if not out or out[-1].tag != "#bare":
            out.append(Node("#bare", "", parent))
        out[-1].parts.append(part)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    _mark_main(builder.root)
    best = _score(builder.root)
    if best is None:
        return ""
    return "\n".join(text for node in _kept(best) for _, text, _ in _blocks(node))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row per page row."""
    picked = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
