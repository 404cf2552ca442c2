"""HTML extraction by composite text density.

For every node of a page's tree, the characters per tag of its subtree are weighed by how few of them are link text
(composite text density). A node's density sum adds up its children's densities, those of inline elements aside, as they
are text of their block. The subtree with the largest sum is the article, and the smallest density on its way up to the
body is the threshold from which other subtrees count too. Each subtree chosen is widened to the article or main element
it stands in.
Scripts, menus, forms, notices and the like are cut from the tree beforehand by element, role and name (class, id). A
name is judged as a whole: one that says nothing but `comments`, `ad-box` or `site-footer` cuts its element, one that has
other words beside (`related-work`, `elementor-widget`) only if the element is mostly links or, outside an article, slight.
What names only its wrapper (role, class, id, form) doesn't cut an element that holds an article or main element or, in
pages without any, most of the plain text; nor do names that nearly all of an article's text carries.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .tables import table

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
#: What a start tag ends, if it is open in the same list, table or block.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_CUT = frozenset("head script style noscript template svg nav footer aside form button select textarea iframe object menu dialog canvas audio video title".split())
#: What may stand in a head; any other element ends it.
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
_CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion sidebar comment comments commentlist disqus "
    "respond replies notice notices cookie cookies consent gdpr menu nav navbar navigation breadcrumb breadcrumbs footer share sharing social related "
    "newsletter subscribe subscription signup login popup modal overlay widget pagination pager toolbar masthead skip".split()
)
#: Words of layout: beside a word of the list above they change nothing.
_LAYOUT = frozenset(
    "area article bar bars block blog body bottom box boxes button buttons card center container content entry form global group header icon icons inner "
    "item items left link links list main module outer page panel placeholder post posts primary right row secondary section site slot thread title top unit wrap wrapper".split()
)


class Node:
    __slots__ = ("tag", "parent", "items", "cut", "name", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, cut: int, name: str = ""):
        self.tag, self.parent, self.items, self.cut, self.name = tag, parent, [], cut, name
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


#: Cut whatever it holds; cut unless it turns out to hold the article; cut if it is slight.
ALWAYS, UNLESS_MAIN, IF_SLIGHT = 3, 2, 1
#: Characters of plain text with which an element outside an article isn't slight.
SLIGHT = 200


@lru_cache(maxsize=1 << 14)
def _attributes(text: str) -> tuple[int, str, bool]:
    """What the attributes of a start tag say: a cut, the name it comes from, and whether the name is `header` alone."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), a or b or c)
    if found.get("hidden", "until-found").lower() != "until-found" or found.get("aria-hidden", "").lower() == "true" or _HIDING.search(found.get("style", "")):
        return ALWAYS, "", False
    if not _CUT_ROLES.isdisjoint(found.get("role", "").lower().split()):
        return UNLESS_MAIN, "", False
    slight = ""
    for name in (*found.get("class", "").split(), *found.get("id", "").split()):
        parts = [p.lower() for p in _PART.findall(name)]
        if not _CUT_WORDS.isdisjoint(parts):
            if all(p in _CUT_WORDS or p in _LAYOUT or len(p) < 3 or p.isdigit() for p in parts):
                return UNLESS_MAIN, name.lower(), False
            slight = slight or name.lower()
    if slight:
        return IF_SLIGHT, slight, False
    return 0, "", "header" in (found.get("class", "").lower(), found.get("id", "").lower())


def _cut(tag: str, attributes: str, inside: bool) -> tuple[int, str]:
    """Whether an element is no part of an article, and by which name; inside: it stands in an article or main element."""
    if (tag in _CUT and tag != "form") or (tag == "header" and not inside):
        return ALWAYS, ""
    if tag in ("html", "body", "article", "main"):
        return 0, ""
    cut, name, header = _attributes(attributes) if attributes and not attributes.isspace() else (0, "", False)
    if tag == "form" or header and not inside:
        cut = max(cut, UNLESS_MAIN)
    return cut, name


def parse(page: str) -> Node:
    """The tree of a page, however broken: elements that are never closed end with what holds them.

    How many elements of a tag are open is counted, so an end tag without a start takes constant time.
    """
    root = node = Node("body", None, 0)
    at, size = 0, len(page)
    opened: dict[str, int] = {}

    def back(to: Node) -> Node:
        """Closes elements until `to` is the current one."""
        up = node
        while up is not to:
            opened[up.tag] -= 1
            up = up.parent
        return up

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            break
        if m.start() > at:
            if node.tag == "head" and not page[at : m.start()].isspace():
                node = back(node.parent)
            node.items.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            # an inline end tag doesn't reach over a block
            up = node
            while opened.get(tag) and up is not root and up.tag != tag and (tag in _BLOCKS or up.tag not in _BLOCKS):
                up = up.parent
            if up is not root and up.tag == tag:
                node = back(up.parent)
            elif tag == "p":
                node.items.append(None)
            continue
        if tag == "body" and opened.get("head"):
            up = node
            while up.tag != "head":
                up = up.parent
            node = back(up.parent)
        if tag in ("html", "body"):
            continue
        if node.tag == "head" and tag not in _HEAD:
            node = back(node.parent)
        ends = _ENDS.get(tag)
        up = node
        if ends:
            while any(map(opened.get, ends)) and up is not root and up.tag not in ends and up.tag not in _SCOPES[tag]:
                up = up.parent
            if up is not root and up.tag in ends:
                node = back(up.parent)
        elif tag in _BLOCKS:
            while opened.get("p") and up is not root and up.tag != "p" and up.tag not in _BLOCKS:
                up = up.parent
            if up is not root and up.tag == "p":
                node = back(up.parent)
        new = Node(tag, node, *_cut(tag, m[3], bool(opened.get("article") or opened.get("main"))))
        node.items.append(new)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            new.items.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in _VOID and not m[3].endswith("/"):
            opened[tag] = opened.get(tag, 0) + 1
            node = new
    if at < size:
        if node.tag == "head" and not page[at:].isspace():
            node = node.parent
        node.items.append(page[at:])
    return root


def _spare(root: Node) -> None:
    """Decides on elements that are cut if slight, and takes back the cut of those around an article or main element, if
    none stands elsewhere, and of those that hold most of the plain text of the article or main element they stand in (in
    pages without any: of the page), alone or with all others of the same name."""
    nodes = [root]
    for node in nodes:
        nodes += [x for x in node.items if isinstance(x, Node) and x.cut != ALWAYS]
    if not any(node.cut for node in nodes):
        return
    plain, links = dict.fromkeys(map(id, nodes), 0), dict.fromkeys(map(id, nodes), 0)
    holds = set()
    for node in reversed(nodes):
        own = id(node)
        plain[own] += sum(len(" ".join(x.split())) for x in node.items if isinstance(x, str))
        if node.tag == "a":
            plain[own], links[own] = 0, plain[own] + links[own]
        if node.parent is not None:
            plain[id(node.parent)] += plain[own]
            links[id(node.parent)] += links[own]
            if node.tag in ("article", "main") or own in holds:
                holds.add(id(node.parent))
    within: dict[int, Node | None] = {id(root): None if holds else root}
    for node in nodes[1:]:
        within[id(node)] = node if node.tag in ("article", "main") else within[id(node.parent)]
        if node.cut == IF_SLIGHT:
            inside = holds and within[id(node)] is not None
            slight = links[id(node)] > plain[id(node)] or not inside and plain[id(node)] < SLIGHT
            node.cut = UNLESS_MAIN if slight else 0
    while holds:
        seen = [root]
        for node in seen:
            seen += [x for x in node.items if isinstance(x, Node) and not x.cut]
        if any(node.tag in ("article", "main") for node in seen):
            break
        for node in seen:
            for x in node.items:
                if isinstance(x, Node) and id(x) in holds and x.cut != ALWAYS:
                    x.cut = 0
    of_name: dict[tuple[int, str], int] = {}
    under = {id(root): False}
    for node in nodes[1:]:
        scope = within[id(node)]
        under[id(node)] = under[id(node.parent)] or bool(node.cut)
        if node.cut and scope is not None:
            if 2 * plain[id(node)] > plain[id(scope)]:
                node.cut = 0
            elif node.name and not under[id(node.parent)]:
                key = id(scope), node.name
                of_name[key] = of_name.get(key, 0) + plain[id(node)]
    for node in nodes[1:]:
        scope = within[id(node)]
        if node.cut and scope is not None and 10 * of_name.get((id(scope), node.name), 0) > 9 * plain[id(scope)]:
            node.cut = 0


def _uncut(root: Node) -> list[Node]:
    """The nodes that stay, parents before children."""
    out = [root]
    for node in out:
        node.items = [x for x in node.items if not (isinstance(x, Node) and x.cut)]
        out += [x for x in node.items if isinstance(x, Node)]
    return out


def _weigh(nodes: list[Node]) -> None:
    for node in nodes:
        node.chars = sum(len(" ".join(x.split())) for x in node.items if isinstance(x, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, 1
    for node in reversed(nodes):
        if node.tag == "a":
            node.link_chars = node.chars
        if node.parent is not None:
            up = node.parent
            up.chars, up.tags = up.chars + node.chars, up.tags + node.tags + 1
            up.link_chars, up.link_tags = up.link_chars + node.link_chars, up.link_tags + node.link_tags
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        if node.chars:
            tags, links = max(1, node.tags), max(1, node.link_chars)
            plain = max(1, node.chars - node.link_chars)
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
            value = max(node.chars / links * tags / max(1, node.link_tags), 1.0)
            node.density = node.chars / tags * math.log(value) / math.log(base) if base > 1 else node.chars / tags * math.log(value)
    for node in nodes[1:]:
        if node.tag not in _INLINE:  # these are text of their block
            node.parent.sum += node.density


def select(nodes: list[Node]) -> list[Node]:
    """The subtrees that make up the article, in page order; nodes: parents before children."""
    body = nodes[0]
    main = max(nodes, key=lambda n: n.sum)  # the first of equals
    threshold, up = main.density, main
    while up is not None:
        threshold, up = min(threshold, up.density), up.parent
    # for every node, from above: the nearest article around it (or itself), else the outermost main, else itself
    articles: dict[int, Node | None] = {}
    mains: dict[int, Node | None] = {}
    for node in nodes:
        above = id(node.parent)
        articles[id(node)] = node if node.tag == "article" else articles.get(above)
        mains[id(node)] = mains.get(above) or (node if node.tag == "main" else None)
    # and from below: the largest density sum within it, the outermost and first of equals
    largest = {}
    for node in reversed(nodes):
        best = node
        for x in node.items:
            if isinstance(x, Node) and largest[id(x)].sum > best.sum:
                best = largest[id(x)]
        largest[id(node)] = best
    chosen = [main, *(largest[id(node)] for node in nodes if node.density >= threshold)]
    marked = {id(articles[id(x)] or mains[id(x)] or x) for x in chosen}
    out, stack = [], [body]
    while stack:
        top = stack.pop()
        if id(top) in marked:
            out.append(top)
        else:
            stack += [x for x in reversed(top.items) if isinstance(x, Node)]
    return out


def text_of(nodes: list[Node]) -> str:
    """The blocks of some subtrees: white space of each as single spaces, blocks joined by line breaks."""
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        if text := " ".join("".join(run).split()):
            blocks.append(text)
        run.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                run.append(html.unescape(x) if "&" in x else x)
            else:
                block = x.tag in _BLOCKS
                if block:
                    end()
                    stack.append(None)
                elif x.tag == "br":
                    run.append(" ")
                stack += reversed(x.items)
        end()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    """The main text of a page; empty for null and for pages without any."""
    if not page:
        return ""
    root = parse(page)
    _spare(root)
    nodes = _uncut(root)
    _weigh(nodes)
    return text_of(select(nodes))


def extract(pages: DataFrame) -> DataFrame:
    """Rows page_id, url, text, n_chars for `pages` (page_id, url, html), one for each row, in one scan.

    Null html gives an empty text; null ids and urls are carried; repeated pages are extracted each; other columns are
    ignored. Of subtrees with equal density sums the outermost, first one counts. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tokens.slices(batches, "html"):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1(spark, sf_dir: str) -> DataFrame:
    """The main text of every page, one row for each, repeats included; edge cases as in extract."""
    return extract(table(spark, sf_dir, "pages"))
