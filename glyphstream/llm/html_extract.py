"""Main text of a page by composite text density.

A page becomes a tree without what is never text (scripts, styles, controls). Every node gets a density: characters per tag, adjusted
by the share of them in links; one is added within both logarithms, so that a page without links has densities too. Every node's density sum
is the sum over its children, and the node with the largest sum is the core of the article. Tags and names (class, id or role) only lower
this: boxes that they call menus, headers, footers, sidebars, notices, adverts, forms or comments count a quarter, and once
the core is found they are cut, unless they hold it or <main>, or the core would keep less than a quarter of its text (body: none) without them.

The densities of the whole page, before the cut, set the thresholds, body's above all, the least on most paths. From the core the article widens to the highest box on its path that is clearly
denser than body (1.25 times); a core that is body itself is left for those of its subtrees that are denser than it. Beside the
article, subtrees off its path belong to it if they reach the least density on the path.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.llm.common import read, small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<(?=[a-zA-Z/])[^>]*$", re.S)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HIDDEN = frozenset("head script style textarea title xmp iframe noembed noframes noscript template button select option input object embed svg canvas audio video map".split())
ASIDE = frozenset("nav header footer aside form dialog menu".split())
BOXES = frozenset("div section ul ol dl table details figure center fieldset".split())
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary"}
PEERS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NAMES = r"ads?|advert[a-z]*|banner|sponsor[a-z]*|promo[a-z]*|sidebar[a-z]*|side|nav[a-z]*|menu[a-z]*|breadcrumbs?|comments?|disqus|replies|reply|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend[a-z]*|footer|header|masthead|toolbar|widget|pagination|pager|tags"
PLACES = r"site|global|primary|secondary|top|bottom|left|right|list|bar|box|block|links|area|wrap|wrapper|container|inner|outer|item|items|section|[0-9]+"
#: A whole class token (or id) made of listed names and words of place: site-footer, but not has-sidebar, menu-open or sticky-header.
NAMED = re.compile(rf"(?<!\S)(?:(?:{PLACES}|main|page|post|article|entry|blog)[-_]+)*(?:{NAMES}|commentlist)(?:[-_]+(?:{NAMES}|{PLACES}))*(?!\S)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
SPACE = re.compile(r"\s+")


class Node:
    """low: a tag or a name calls the node boilerplate. at, end: its place in page order and that after its subtree."""

    __slots__ = ("tag", "parent", "kids", "cut", "low", "at", "end", "chars", "tags", "link_chars", "link_tags", "density", "total", "full")

    def __init__(self, tag, parent, cut=False, low=False):
        self.tag, self.parent, self.kids, self.cut, self.low = tag, parent, [], cut, low

    def holds(self, other) -> bool:
        return self.at <= other.at < self.end


def _lowered(tag: str, attrs: str) -> bool:
    """Boilerplate by tag, or by the class, id or role of a box; paragraphs, headings and the like have no say, nor have body, article and main."""
    if tag in ASIDE:
        return True
    if tag not in BOXES or not attrs:
        return False
    for name, a, b, c in ATTR.findall(attrs):
        value = a or b or c
        if value.lower() in ROLES if name.lower() == "role" else NAMED.search(value):
            return True
    return False


def parse(page: str) -> Node:
    """Tree of a page with the end tags that HTML implies; stray end tags are ignored. Text is in kids as strings."""
    root = at = Node("#root", None)
    pos, end, open_tags = 0, len(page), Counter()

    def shut(inner: Node, outer: Node) -> Node:
        """Close the open nodes from inner to outer; outer's parent is open then."""
        while inner is not outer.parent:
            open_tags[inner.tag] -= 1
            inner = inner.parent
        return inner

    while pos < end:
        m = TOKEN.search(page, pos)
        stop = m.start() if m else end
        if stop > pos:
            at.kids.append(html.unescape(page[pos:stop]))
        if not m:
            break
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            up = at if open_tags[tag] else root
            while up is not root and up.tag != tag:
                if tag == "p" and up.tag in ("div", "article", "section", "main", "body", "td", "li", "blockquote"):
                    up = root
                    break
                up = up.parent
            if up is not root:
                at = shut(at, up)
            continue
        if tag in CLOSES_P or tag in PEERS:
            closing, fence = ("p",) if tag in CLOSES_P else PEERS[tag], FENCE.get(tag, ("div", "article", "section", "main", "body", "td", "th", "li", "blockquote", "table", "button", "object"))
            up = at
            while up is not root and up.tag not in fence:
                if up.tag in closing:
                    at = shut(at, up)
                    if tag not in PEERS:
                        break
                up = up.parent
        node = Node(tag, at, tag in HIDDEN, tag not in HIDDEN and _lowered(tag, m[3]))
        at.kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            pos = close.end() if close else end
        elif tag not in VOID and (not m[3].rstrip().endswith("/") or tag not in ("svg", "path")):
            at = node
            open_tags[tag] += 1
    return root


def _walk(root: Node) -> list[Node]:
    """Nodes that are not cut, in page order, each with its place and that after its subtree."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        n.at = n.end = len(order)
        order.append(n)
        stack += [k for k in reversed(n.kids) if isinstance(k, Node) and not k.cut]
    for n in reversed(order):
        n.end = max(n.end, n.at + 1)
        if n.parent is not None:
            n.parent.end = max(n.parent.end, n.end)
    return order


def _densities(root: Node) -> tuple[Node, list[Node]]:
    """Body, and its nodes in page order, with densities and density sums."""
    nodes = _walk(root)
    for n in reversed(nodes):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len(SPACE.sub(" ", k).strip())
            elif not k.cut:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags + (k.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    body = next((n for n in nodes if n.tag == "body"), root)
    ratio = body.link_chars / max(1, body.chars)
    for n in reversed(nodes):
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = math.log(c / max(1, c - n.link_chars) * n.link_chars + ratio * c + math.e)
        n.density = c / t * math.log(c * t / (lc * lt) + 1.0) / math.log(base + 1.0) if c else 0.0
        n.total = sum(k.density / (4 if k.low else 1) for k in n.kids if isinstance(k, Node) and not k.cut)
    return body, nodes[body.at : body.end]


def _above(n: Node, top: Node):
    """Ancestors of n below top."""
    n = n.parent
    while n is not None and n is not top:
        yield n
        n = n.parent


def _cut_lowered(root: Node) -> None:
    """Keep the whole page's densities as full, cut the boxes that tags or names call boilerplate, and clear the mark of those that stay."""
    body, nodes = _densities(root)
    for n in (body, *nodes):
        n.full = n.density
    low = [n for n in nodes if n.low]
    if not low:
        return
    under = {}
    for n in nodes:
        under[n] = n.low or under.get(n.parent, False)
    core = max(nodes, key=lambda n: n.total / (4 if under[n] else 1))
    needed = [core, *(n for n in nodes if n.tag == "main" and n.chars)]
    inside = [n for n in low if core.holds(n) and not any(n.holds(x) for x in needed)]
    lost, last = 0, -1
    for n in inside:
        if n.at >= last:  # the outermost only
            lost, last = lost + n.chars - n.link_chars, n.end
    whole = core.chars - core.link_chars
    left = whole - lost
    keep = set(inside) if (not left if core is body else 4 * left < whole) else set()
    for n in low:
        n.cut = n not in keep and not any(n.holds(x) for x in needed)
        n.low = False


def _chosen(root: Node, clear: float = 1.25) -> list[Node]:
    """The subtrees that are the article, in page order."""
    _cut_lowered(root)
    body, nodes = _densities(root)
    core = max(nodes, key=lambda n: n.total)
    if core.total == 0:
        return [body]
    if core is body:
        out = [k for k in body.kids if isinstance(k, Node) and not k.cut and k.chars and k.full > body.full]
        loose = any(isinstance(k, str) and k.strip() for k in body.kids)  # text that is body's own
        return [body] if loose or not out else out
    path = list(_above(core, body))
    least = min(n.full for n in (core, *path, body))
    top = next((n for n in reversed(path) if n.full >= clear * body.full), core)
    if top is not core:
        path = list(_above(top, body))
    beside, last = {top}, -1
    for n in nodes:  # topmost subtrees off the path; none of their parts is met again
        if n.at >= last and n is not body and not n.holds(top):
            last = n.end if top.holds(n) or n.density >= least and n.chars else last
            if n.chars and n.density >= least and not top.holds(n):
                beside.add(n)
    return sorted(beside, key=lambda n: n.at)


def _blocks(n: Node) -> list[str]:
    """Texts of the blocks of a subtree in page order, white space made one space, empty ones dropped."""
    out, held = [], []

    def flush():
        text = SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            out.append(text)

    stack: list = [n]
    while stack:
        k = stack.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            held.append(k)
        elif not k.cut or k is n:
            if k.tag in BLOCK:
                flush()
                stack.append(None)
            elif k.tag == "br":
                held.append(" ")
            stack += reversed(k.kids)
    flush()
    return out


def extract(page: str | None) -> str:
    """Main text of one whole page; null and empty pages, and pages without text, give ''. Of nodes with equal sums the outermost, first one is the core."""
    if not page:
        return ""
    root = parse(page)
    return "\n".join(b for n in _chosen(root) for b in _blocks(n))


def extract_pages(spark: SparkSession, pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with a column text (replacing one of that name; other columns stay), the main text of html_col. Repeated pages are read each;
    an empty table gives no rows.
    """
    small_batches(spark)

    @F.udf("string", useArrow=True)
    def main_text(page):
        return extract(page)

    return pages.withColumn("text", main_text(F.col(html_col)))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(spark, pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
