"""Main text of web pages by composite text density.

Every DOM node gets a density: characters per tag, adjusted by the share of characters and
tags that belong to links. A block's density sum is the sum of its children's densities (its
own density where it has no block children); the block with the largest sum heads the main text. The
smallest density on the path from there to the body is the bar for everything beside the path: of a block that
reaches it the subtree with the largest sum belongs to the text too, others are pruned.

Boilerplate that pages declare themselves (navigation, headers and footers of the page, asides,
forms, hidden nodes, and blocks whose class, id or role names adverts, menus, notices, sharing or
comments) is pruned before densities are taken, but never a node that holds the page's largest article
container or, on a page without one, most of its plain text: such a node is a wrapper, and density judges it. An
article container that holds the densest block is taken whole, and nothing beside it.

Pages are independent rows, so the work is one pass over the table without a shuffle. Python runs
on Arrow batches; memory is bounded by one batch and one page's tree, and time is linear in a page's length.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|([!?]))")
#: An attribute with any kind of value, and without double, single or both quotes where none closes any more.
_ATTRS = {
    (d, q): re.compile(r"[\s/]*([^\s/>][^\s=/>]*)(?:\s*=\s*(?:" + (r'"([^"]*)"|' if d else "(?!)()|") + ("'([^']*)'|" if q else "(?!)()|") + r"([^\s>]*)))?") for d in (True, False) for q in (True, False)
}
#: Elements whose content is text without markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text, whatever they hold.
_DROP = frozenset("script style noscript template button select textarea iframe svg canvas object title xmp noembed noframes".split())
_DECLARED = frozenset("nav aside form dialog menu".split())
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag ends an open element of these kinds.
_ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "p": ("button", "td", "th", "table", "caption", "object")}
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|aside|footer|foot|masthead|topbar|toolbar|"
    r"cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|widget|pagination|pager|skip)(?:$|[\s_-])",
    re.I,
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|disqus|replies|feedback|discussion)(?:$|[\s_-])", re.I)
_PAGE_HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-?header|page-?header)(?:$|[\s_-])", re.I)
#: Names that say what a block has or lacks, not what it is.
_ABOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|hide|show)[_-]\S*", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_ARTICLE = frozenset(("article", "main"))
#: Text blocks of an article: a name of several parts, such as ``share-price``, may speak of what they say, so only links prove that it does not.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption".split())
_IF_LINKS = -1.0
#: Share of a page's plain text that makes a declared block a wrapper; reader comments often outgrow the article.
_WRAPPER, _COMMENT_WRAPPER = 0.5, 0.95


class _Node:
    __slots__ = ("tag", "parent", "parts", "article", "within", "cut", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: _Node | None, article: bool = False):
        self.tag, self.parent, self.article, self.cut = tag, parent, article, 0.0
        self.within = article or parent is not None and parent.within
        self.parts: list = []


def _attributes(page: str, at: int, double: int, single: int) -> tuple[dict[str, str], int, bool]:
    """Attributes of a tag, the place behind it, and whether it closes itself; ``double`` and ``single``: the page's last quotes."""
    found: dict[str, str] = {}
    end = len(page)
    while True:
        m = _ATTRS[at < double, at < single].match(page, at)
        if m is None or m.end() == at:
            break
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()
    close = page.find(">", at)
    if close < 0:
        return found, end, False
    return found, close + 1, page[close - 1] == "/"


def _declared(tag: str, attrs: dict[str, str], inside: bool) -> float:
    """0 for nodes the page does not mark as something else than article text, else the share of plain text that proves it a wrapper."""
    if tag in _DECLARED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return _WRAPPER
    if tag in _ARTICLE or attrs.get("itemprop") == "articleBody":
        return 0.0
    if tag == "footer" or tag == "header" and not inside or attrs.get("role", "").lower() in _ROLES:
        return _WRAPPER
    names = _ABOUT.sub(" ", f"{attrs.get('class', '')} {attrs.get('id', '')}")
    if _COMMENTS.search(names):
        return _COMMENT_WRAPPER
    if inside and tag in _TEXT:
        said = [name for name in names.split() if _BOILER.search(name)]
        return _WRAPPER if any(_BOILER.fullmatch(name) for name in said) else _IF_LINKS if said else 0.0
    return _WRAPPER if _BOILER.search(names) or not inside and _PAGE_HEADER.search(names) else 0.0


def parse(page: str) -> _Node:
    """The page's tree without scripts, styles and the like; unclosed and stray tags are repaired.

    A place in the stack of open elements is kept for every tag, so that a closing tag or an implied end costs
    no search. A quote that nothing closes is part of a value without quotes.
    """
    root = _Node("body", None)
    stack, open_ = [root], {}
    double, single, end, at, begun, in_head = page.rfind('"'), page.rfind("'"), len(page), 0, 0, False

    def up_to(depth: int) -> None:
        while len(stack) > depth:
            open_[stack.pop().tag].pop()

    def last(tags) -> int:
        return max((open_[t][-1] for t in tags if open_.get(t)), default=0)

    def text(upto: int) -> None:
        nonlocal in_head
        if begun < upto and (said := page[begun:upto]):
            if in_head and said.strip():
                in_head = False
            stack[-1].parts.append(html.unescape(said) if "&" in said else said)

    while m := _OPEN.search(page, at):
        if m[3] or m[4]:
            text(m.start())
            stop = page.find("-->" if m[3] else ">", m.end())
            at = begun = end if stop < 0 else stop + (3 if m[3] else 1)
            continue
        text(m.start())
        tag, closing = m[2].lower(), bool(m[1])
        attrs, at, void = _attributes(page, m.end(), double, single)
        begun = at
        if tag in ("html", "body"):
            in_head = False
            continue
        if tag == "head":
            in_head = not closing
            continue
        if closing:
            depth = last((tag,))
            if depth and not (tag in _INLINE and any(x.tag not in _INLINE for x in stack[depth + 1 : depth + 65])):
                up_to(depth)
            continue
        if in_head and tag not in _IN_HEAD:
            in_head = False
        if tag in _RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = begun = end if stop is None else page.find(">", stop.start()) + 1 or end
            continue
        void = void or tag in _VOID
        if tag in _ENDS_P:
            if (depth := last("p")) > last(_SCOPE["p"]):
                up_to(depth)
        if tag in _SELF_END and (depth := last(_SELF_END[tag])) > last(_SCOPE[tag]):
            up_to(min(open_[t][-1] for t in _SELF_END[tag] if open_.get(t) and open_[t][-1] > last(_SCOPE[tag])))
        node = stack[-1]
        child = _Node(tag, node, tag in _ARTICLE or attrs.get("itemprop") == "articleBody" or attrs.get("role") in ("main", "article"))
        child.cut = 2.0 if tag in _DROP else _declared(tag, attrs, node.within) if attrs or tag in _DECLARED or tag in ("header", "footer") else 0.0
        node.parts.append(child)
        if not void:
            open_.setdefault(tag, []).append(len(stack))
            stack.append(child)
    text(end)
    return root


def _count(nodes: list[_Node]) -> None:
    """Characters, tags and what of them belongs to links, from the leaves up."""
    for node in reversed(nodes):
        kids = [x for x in node.parts if not isinstance(x, str)]
        node.chars = sum(len(x.strip()) for x in node.parts if isinstance(x, str)) + sum(k.chars for k in kids)
        node.tags = sum(k.tags + 1 for k in kids)
        node.link_chars = node.chars if node.tag == "a" else sum(k.link_chars for k in kids)
        node.link_tags = sum(k.link_tags + (k.tag == "a") for k in kids)


def prune(root: _Node) -> None:
    """Cut what the page declares not to be its text, but no node that wraps the text itself."""
    for node in _order(root):
        node.parts = [x for x in node.parts if isinstance(x, str) or x.cut < 2]
    nodes = _order(root)
    _count(nodes)
    plain = {id(n): n.chars - n.link_chars for n in nodes}
    for node in nodes:
        if node.cut == _IF_LINKS:
            node.cut = _WRAPPER if 2 * node.link_chars > node.chars else 0.0
    held = {id(root): 0.0}  # the strongest mark above a node
    for node in nodes[1:]:
        held[id(node)] = max(node.cut, held[id(node.parent)])
    boxes = [n for n in nodes if n.article and plain[id(n)]]
    wraps: set[int] = set()
    if boxes:  # containers among reader comments stand back behind others
        main = max(boxes, key=lambda n: (held[id(n)] < _COMMENT_WRAPPER, plain[id(n)]))
        while main is not None:
            wraps.add(id(main))
            main = main.parent
    else:
        most = max(plain[id(root)], 1)
        wraps = {id(n) for n in nodes if plain[id(n)] > n.cut * most}
    for node in nodes:
        node.parts = [x for x in node.parts if isinstance(x, str) or not x.cut or id(x) in wraps]


def _order(root: _Node) -> list[_Node]:
    found = [root]
    for node in found:
        found.extend(x for x in node.parts if not isinstance(x, str))
    return found


def densities(root: _Node) -> list[_Node]:
    """Set every node's counts, density and density sum; parents come first in the result."""
    nodes = _order(root)
    _count(nodes)
    chars, links = max(root.chars, 1), root.link_chars
    for node in reversed(nodes):
        if not node.chars:
            node.density = node.total = 0.0
            continue
        tags, plain = max(node.tags, 1), node.chars - node.link_chars
        # links shrink a node's density; the logarithm's base grows where links prevail
        base = math.log(node.chars / max(plain, 1) * node.link_chars + links / chars * node.chars + math.e)
        ratio = node.chars / max(node.link_chars, 1) * tags / max(node.link_tags, 1)
        node.density = node.chars / tags * math.log(max(ratio, 1.0) + 1.0) / max(base, 1.0)
        blocks = sum(k.density for k in node.parts if not isinstance(k, str) and k.tag not in _INLINE and k.tag != "br")
        # text beside block children counts as a block of its own
        node.total = blocks + _loose(node) if blocks else node.density
    return nodes


def _loose(node: _Node) -> int:
    return sum(len(x.strip()) if isinstance(x, str) else x.chars - x.link_chars for x in node.parts if isinstance(x, str) or x.tag in _INLINE)


def _container(node: _Node) -> _Node | None:
    """The article container a node lies in: the innermost, or one above that holds most of its plain text outside it."""
    found = None
    while node is not None:
        if node.article and (found is None or node.chars - node.link_chars > 2 * (found.chars - found.link_chars)):
            found = node
        node = node.parent
    return found


def main_nodes(root: _Node) -> list[_Node]:
    """The subtrees that make up the main text, in page order; none where the page has no text left."""
    nodes = [n for n in densities(root) if n.chars and n.tag not in _INLINE]
    if not nodes:
        return []
    best = max(nodes, key=lambda n: n.total)
    box = _container(best)
    if box is not None:
        return [box]
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    bar = min(n.density for n in path)
    found = {id(best)}

    def largest(top: _Node) -> _Node:
        return max((n for n in _order(top) if n.chars and n.tag not in _INLINE), key=lambda n: n.total)

    for above, below in zip(path[1:], path, strict=False):
        for part in above.parts:
            if not isinstance(part, str) and part is not below and part.chars and part.tag not in _INLINE and part.density >= bar:
                found.add(id(largest(part)))
    if _loose(root) > best.chars:  # text that lies in the body itself has no container of its own
        return [root]
    out: list[_Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if id(node) in found:
            out.append(node)
        else:
            todo.extend(x for x in reversed(node.parts) if not isinstance(x, str))
    return out


def blocks(node: _Node) -> list[str]:
    """Texts of the subtree's blocks in page order; inline nodes don't part a block."""
    found: list[str] = []
    run: list[str] = []

    def cut() -> None:
        if text := " ".join("".join(run).split()):
            found.append(text)
        run.clear()

    stack: list = [iter((node,))]
    names: list[str] = [""]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            if names.pop() not in _INLINE:
                cut()
        elif isinstance(x, str):
            run.append(x)
        else:
            if x.tag not in _INLINE:
                cut()
            stack.append(iter(x.parts))
            names.append(x.tag)
    cut()
    return found


def main_text(page: str | None) -> str:
    """Main text of one page; empty for null, empty or textless pages."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return " ".join(x for node in main_nodes(root) for x in blocks(node))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Add the main text of every page and its number of code points.

    Null and empty pages, and pages that hold nothing but boilerplate, get an empty text. Rows are
    kept one for one, repeated ones too; all other columns pass, and columns that bear the names of
    the new ones are replaced. An empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text)

    return pages.withColumn(text_col, texts(F.col(html_col))).withColumn(chars_col, F.length(text_col).cast("long"))


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
