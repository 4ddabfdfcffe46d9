"""Main text of HTML pages by composite text density.

A page is read into a tree of elements with a tolerant scanner. For every node, C characters, T
tags, and of these LC and LT inside links, are counted; its density is C / T, adjusted for links:
``C / T * log(C / LC * T / LT)`` to the base ``C / (C - LC) * LC + LC_body / C_body * C + e`` (the
iterated logarithm that is also in use is 0 where a page has no link). The density sum of a node is
the sum of its children's densities, text right under it counting as one child. The node with the
greatest density sum is the content's root, and the least density on the path from body to it the
threshold: of what lies beside that path, nodes that reach the threshold are main text as well, with
headings among them. All of a chosen subtree is kept, but for menus: elements, not paragraphs or
headings, of two or more links that hold most of its text, below the threshold. Where the root lies
in an ``article`` or ``main`` element, the whole outermost article, or else the main element, is chosen.

Elements that never hold main text (menus, footers, asides, scripts, styles, headers outside an
article and the like) and those with a role of that kind are cut before counting, and so is what
class or id calls comments, unless nothing would be left. Forms, and what class or id calls an advert,
sidebar, notice or similar, are cut unless density says otherwise: one that holds the content's root
and most of the page's text is the page. A class word is split at "-" and "_": it names such an
element if one of its parts does and all others are of the same kind or tell of layout. So
"site-sidebar", "c-comments__list" and "cookie-bar" do, "has-sidebar", "ad-hoc-analysis" and
"widget-free" don't.

Blocks are joined in page order by one newline; white space in a block becomes one space; character
references are decoded once.

Rules: null html counts as empty and gives an empty text. Unclosed, misnested or cut-off markup
is read as far as it goes; a quoted value that never ends reaches to the end of the page. A page
without any main text gives an empty string. Time is linear in the length of a page, however deep
or broken. Rows that repeat are extracted alike; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of elements, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
CUT = frozenset(
    "head script style noscript template title nav header footer aside button select option textarea input "
    "iframe object embed applet svg math canvas audio video map menu dialog noframes noembed xmp datalist".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("html body table td th ul ol dl div article section main blockquote figure".split())
#: Class words by which pages name what isn't main text.
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal newsletter "
    "subscribe subscription signup share sharing social related recommended recommendations footer masthead pagination pager "
    "widget widgets toolbar login search bio".split()
)
#: Parts that don't change what a word with one of those names: layout and position.
LAYOUT = frozenset(
    "site page main post posts entry article articles user reader author left right top bottom side bar box block area section "
    "container wrapper wrap list item items inner outer panel slot unit c l m js primary secondary global header head title links link "
    "buttons button icons icon form forms group row column col thread sticky fixed mobile desktop message card cards".split()
)
WHOLE = frozenset("site-header page-header side-bar".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S
)
_NAMES = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")  # every attribute, with its value
_SPACE = re.compile(r"\s+")
_PARTS = re.compile("[-_]+")
KEPT, DOUBTED, COMMENTED, GONE = 0, 1, 2, 3


class Node:
    __slots__ = ("chars", "children", "commented", "density", "doubted", "inline_open", "link_chars", "links", "name", "outer", "parent", "scope", "scope_open", "sum", "tags")

    def __init__(self, name: str, parent: Node | None, verdict: int = KEPT):
        self.name, self.parent, self.children = name, parent, []
        self.doubted, self.commented = verdict == DOUBTED, verdict == COMMENTED
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.sum = 0.0
        # The nearest element around the node's content that isn't inline, and the nearest one that
        # bounds implied end tags; both count the open elements in them by name.
        self.outer = parent.outer if parent is not None and name in INLINE else self
        self.scope = parent.scope if parent is not None and name not in SCOPE else self
        self.inline_open = Counter() if self.outer is self else None
        self.scope_open = Counter() if self.scope is self else None


def _named(word: str) -> int:
    """What a class word calls its element."""
    parts = [p for p in _PARTS.split(word) if p]
    kinds = [COMMENTED if p in COMMENTS else DOUBTED if p in BOILER else KEPT for p in parts]
    if word in WHOLE:
        return DOUBTED
    return max(kinds, default=KEPT) if all(k or p in LAYOUT or p.isdigit() for k, p in zip(kinds, parts, strict=True)) else KEPT


def _verdict(name: str, attributes: str, in_article: bool) -> int:
    if name in CUT and not (name == "header" and in_article):
        return GONE
    found = DOUBTED if name == "form" else KEPT
    if not attributes or name in ("body", "html", "article", "main"):
        return found
    for key, value in _NAMES.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            found = max([found, *map(_named, value.split())])
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return GONE
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return GONE
    return found


class _Tree:
    """The open elements while a page is read. Every walk up closes what it passes, so that all walks
    together are linear."""

    def __init__(self):
        self.root = self.here = Node("body", None)
        self.open: Counter = Counter()

    def enter(self, name: str, verdict: int, stays: bool) -> None:
        node = Node(name, self.here, verdict)
        self.here.children.append(node)
        if stays:
            self.open[name] += 1
            (node.parent.outer.inline_open if name in INLINE else node.parent.scope.scope_open)[name] += 1
            self.here = node

    def close_to(self, name: str) -> None:
        """Close everything up to the nearest open element of that name, which must be open."""
        while True:
            node = self.here
            self.here = node.parent
            self.open[node.name] -= 1
            (node.parent.outer.inline_open if node.name in INLINE else node.parent.scope.scope_open)[node.name] -= 1
            if node.name == name:
                return

    def imply_end(self, name: str) -> None:
        """Close an element of that name, if one is open within the current container."""
        scope = self.here.scope
        if scope.scope_open[name] or scope.name == name and scope.parent is not None:
            self.close_to(name)

    def end(self, name: str) -> None:
        """An end tag; one that closes nothing is passed over."""
        if name == "p" and not self.here.scope.scope_open["p"]:
            self.here.children.append(Node("br", self.here))
        elif self.here.outer.inline_open[name] if name in INLINE else self.open[name]:
            self.close_to(name)


def parse(page: str) -> Node:
    """The tree below body; texts are strings among the children."""
    tree = _Tree()
    at, size = 0, len(page)
    cut: list[str] = []  # open elements inside one that is cut
    inside: Counter = Counter()  # the same by name
    endless: set[str] = set()
    while at < size:
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else size]
        if text and not cut:
            tree.here.children.append(_html.unescape(text))
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if not found[1] and name in RAW:  # to its end tag, whatever is in between
            end = None if name in endless else re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if end is None:
                endless.add(name)
            at = end.end() if end else (at if name == "title" else size)
            continue
        if cut:
            if found[1]:
                if inside[name]:
                    while (last := cut.pop()) != name:
                        inside[last] -= 1
                    inside[name] -= 1
                elif name in ("body", "html", "article", "main"):
                    cut.clear()
                    inside.clear()
                    tree.end(name)
            elif name not in VOID:
                if cut[0] == "head" and name == "body" or len(cut) == 1 and cut[0] in ("p", "li") and name in CLOSES_P:
                    cut.clear()
                    inside.clear()
                    tree.here.children.append(" ")
                else:
                    cut.append(name)
                    inside[name] += 1
            continue
        if found[1]:
            tree.end(name)
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P:
            for other in SIBLINGS.get(name, ()):
                tree.imply_end(other)
            tree.imply_end("p")
        whole = found[3].endswith("/")
        verdict = _verdict(name, found[3], tree.open["article"] > 0)
        if verdict == GONE:
            if name not in VOID and not whole:
                cut.append(name)
                inside[name] += 1
            if name not in INLINE:
                tree.here.children.append(Node("br", tree.here))
            continue
        tree.enter(name, verdict, name not in VOID and not (whole and name not in INLINE))
    return tree.root


def _post_order(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    return order[::-1]


def measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes, children before parents."""
    order = _post_order(root)
    for node in order:
        node.chars = node.tags = node.links = node.link_chars = 0
        for child in node.children:
            if isinstance(child, str):
                node.chars += len("".join(child.split()))
            else:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.links += child.links + (child.name == "a")
                node.link_chars += child.chars if child.name == "a" else child.link_chars
        if node.name == "a":
            node.link_chars = node.chars
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in order:
        node.density = _density(node.chars, node.tags, node.link_chars, node.links, share)
        node.sum = 0.0
        own = 0
        for child in node.children:
            if isinstance(child, Node):
                node.sum += child.density
            else:
                own += len("".join(child.split()))
        node.sum += _density(own, 0, 0, 0, share) if own else 0.0
    return order


def _density(chars: int, tags: int, link_chars: int, links: int, share: float) -> float:
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    ratio = chars / max(link_chars, 1) * max(tags, 1) / max(links, 1)
    return chars / max(tags, 1) * math.log(max(ratio, 1.0)) / base


def _without_comments(root: Node) -> bool:
    """Take what names call comments out of the tree, unless that is all there is. Tells whether any went."""
    found, left, stack = [], root.chars, [root]
    while stack:
        node = stack.pop()
        for i, child in enumerate(node.children):
            if isinstance(child, Node):
                if child.commented:
                    found.append((node, i))
                    left -= child.chars
                else:
                    stack.append(child)
    if not left:
        return False
    for node, i in found:
        node.children[i] = Node("span" if node.children[i].name in INLINE else "br", node)
    return bool(found)


def _without_doubted(root: Node) -> bool:
    """Take the doubted elements out of the tree, but for those that hold the content's root and
    most of the page's text. Tells whether any went."""
    best, holds = _best(root), set()
    node = best
    while node is not None:
        holds.add(node)
        node = node.parent
    gone, stack = False, [root]
    while stack:
        node = stack.pop()
        for i, child in enumerate(node.children):
            if not isinstance(child, Node):
                continue
            if child.doubted and not (child in holds and 2 * child.chars > root.chars):
                node.children[i] = Node("span" if child.name in INLINE else "br", node)
                gone = True
            else:
                stack.append(child)
    return gone


def _best(root: Node) -> Node:
    """The node with the greatest density sum, the first one of equals; of a single paragraph or an
    inline element the one around it, as they hold one block of an article and not the article."""
    best = max(_post_order(root), key=lambda n: n.sum)
    while best.parent is not None and (best.name in INLINE or best.name in ("p", "li", "pre", "blockquote", "br")):
        best = best.parent
    return best


def choose(root: Node) -> tuple[Node, Node, set[Node], float]:
    """The element to read; the content's root, itself and its ancestors; the threshold."""
    best = _best(root)
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    known = set(path)
    threshold = min(n.density for n in path)
    for name in ("article", "main"):
        around = [n for n in path if n.name == name]
        if around:
            return around[-1], around[-1], known, threshold
    share = root.link_chars / root.chars
    top = best
    for node in path[1:]:
        beside = [c.density for c in node.children if isinstance(c, Node) and c not in known and c.chars]
        if max([*beside, _own_density(node, share)]) >= threshold:
            top = node
    return top, best, known, threshold


def _own_density(node: Node, share: float) -> float:
    """Of the text right under a node."""
    return _density(sum(len("".join(c.split())) for c in node.children if isinstance(c, str)), 0, 0, 0, share)


def _blocks(top: Node, best: Node, path: set[Node], threshold: float, share: float) -> list[str]:
    """Of ``best`` and of what reaches the threshold beside the path to it, all but menus."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list = [(top, True)]
    while stack:
        item, opening = stack.pop()
        if isinstance(item, str):
            run.append(item)
            continue
        block = item.name not in INLINE
        if block:
            flush()
        if not opening:
            continue
        menu = item.links > 1 and item.link_chars > 0.5 * item.chars and item.density < threshold
        if menu and block and item is not top and item.name != "p" and item.name not in HEADINGS:
            continue
        if block:
            stack.append((item, False))
        children = item.children
        if item in path and item is not best:
            own = _own_density(item, share) >= threshold
            children = [c for c in children if (own if isinstance(c, str) else c in path or c.density >= threshold or c.name in HEADINGS)]
        stack += [(c, True) for c in reversed(children)]
    flush()
    return out


def extract(page: str) -> str:
    root = parse(page)
    measure(root)
    for without in (_without_comments, _without_doubted):
        if without(root):
            measure(root)
    if not root.chars:
        return ""
    return "\n".join(_blocks(*choose(root), root.link_chars / root.chars))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(p.as_py()) for p in batch.column("html")]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
