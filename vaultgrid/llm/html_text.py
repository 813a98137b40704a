"""Main text of web pages by composite text density.

A page is read into a small DOM (implied end tags, void and raw-text elements,
unclosed markup) in time linear in its length. What is never shown goes first:
scripts, styles, heads, hidden elements.

Every node then has C characters, T tags, LC characters and LT tags in links;
its composite density is ``C/T`` times the logarithm of ``C/LC * T/LT`` to the
base ``ln(C/notLC * LC + LCbody/Cbody * C + e)``. The node with the largest sum
of its children's densities is the core; the smallest density on its path up to
the body is the threshold. Beside the path, subtrees of at least that density
stay whose children are dense themselves: a line of an advert or a footer has no
children that add up. Inside the core's ``article`` or ``main`` what has more
text than links stays.

Names break ties only. Menus, footers, sidebars, forms, and what whole class, id
or role names call a notice, an advert or comments are no cores, and go where
the sum of their densities is below the core's; one that is as dense as the core
is no noise, whatever its name. Where the names leave a page without text, it is
read without them.

Defined cases: a null or empty page gives an empty text and 0; a page without
tags is one block; pages of any length are read whole; repeated rows are
extracted alike; an empty table gives an empty result; columns other than id,
url and html are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small_batches, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|iframe|svg|textarea|select|object|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NONE = re.compile(r"display\s*:\s*none", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption html legend option tbody td tfoot th thead tr".split())
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hold no article, and whole class, id or role names that say so.
NEVER = frozenset("aside dialog footer form input nav menu search".split())
LABEL = re.compile(
    r"(?:ads?|adverts?|advertisements?|advertising|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|disclaimer|disqus|footer|login|masthead|menu|menubar|nav|navbar"
    r"|navigation|newsletter|notices?|pager|pagination|paywall|popup|modal|promo|promotion|recommended|related|replies|respond|share|sharing|sidebar|signup|skyscraper|social|sponsor|sponsored"
    r"|subscribe|subscription|teasers?|toolbar|topbar|widgets?"
    r"|(?:site|page|main|top|left|right|primary|secondary|global|article|post)[-_]?(?:nav|navigation|menu|footer|sidebar|banner|comments?)|(?:nav|menu|footer|sidebar)[-_]?(?:bar|left|right|wrapper|container|main|menu|links)"
    r"|ads?[-_]?(?:slot|unit|box|banner|container|wrapper|block)|(?:google|banner|top|side)[-_]?ads?|(?:cookie|gdpr|consent|privacy)[-_]?(?:banner|notice|bar|popup|consent)"
    r"|comments?[-_]?(?:list|section|area|form|thread|box|wrapper)|(?:user|reader)[-_]?comments?|(?:social|share|sharing)[-_]?(?:links|buttons|bar|icons|tools|media)|newsletter[-_]?(?:signup|form|box)"
    r"|related[-_]?(?:posts|articles|links|stories|content|news)|(?:sign|log)[-_]?(?:up|in)[-_]?(?:form|box)?)",
    re.I,
)


class Node:
    __slots__ = ("tag", "up", "parts", "drop", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, drop: bool = False, noise: bool = False):
        self.tag, self.up, self.drop, self.noise, self.parts = tag, up, drop, noise, []


def judged(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is never shown or never an article, and whether its names say that it is none."""
    if tag == "head":
        return True, False
    if tag in NEVER:
        return False, True
    if not attributes or attributes.isspace():
        return False, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(ATTRIBUTE.finditer(attributes)))}
    if "hidden" in found and found["hidden"].lower() != "until-found" or found.get("aria-hidden", "").strip().lower() == "true" or NONE.search(found.get("style", "")):
        return True, False
    if tag in ("body", "html", "article", "main"):
        return False, False
    return False, any(LABEL.fullmatch(name) for key in ("class", "id", "role") for name in found.get(key, "").split())


class Open:
    """The open elements; the nearest of any name is found without walking up."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def first_after(self, tags, place: int) -> int | None:
        """The outermost open element of these names inside the one at ``place``."""
        found = [p[i] for p in (self.at.get(t, ()) for t in tags) if (i := bisect_right(p, place)) < len(p)]
        return min(found, default=None)

    def close(self, place: int) -> None:
        while len(self.stack) > max(1, place):
            self.at[self.stack.pop().tag].pop()


P_ENDS = ("table", "td", "th", "button", "body")


def parse(page: str) -> Node:
    """The root node; a node's parts are strings and nodes in page order."""
    root = Node("html", None)
    around = Open(root)
    last = 0
    for m in TOKEN.finditer(page, 0, page.rfind(">") + 1):  # no tag ends after the last one
        if m.start() > last:
            around.stack[-1].parts.append(page[last : m.start()])
        last = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag = tag.lower()
        if m[2] or m[5]:
            place = around.last((tag,))
            if place > 0:
                around.close(place)
            continue
        if tag in ("html", "body") and (len(around.stack) == 1 or tag == "html"):
            if tag == "body":
                node = Node("body", root)
                root.parts.append(node)
                around.push(node)
            continue
        if tag in CLOSES_P and (place := around.last(("p",))) > around.last(P_ENDS):
            around.close(place)
        if tag in IMPLIED:
            ends, within = IMPLIED[tag]
            place = around.first_after(ends, around.last(within))
            if place is not None:
                around.close(place)
        if tag == "body" and around.last(("head",)) > 0:
            around.close(around.last(("head",)))
        up = around.stack[-1]
        node = Node(tag, up, *judged(tag, m[4] or m[7] or ""))
        up.parts.append(node)
        if tag not in VOID:
            around.push(node)
    if last < len(page):
        tail = page[last:]
        if not re.match(r"<[a-zA-Z/!]", tail):
            around.stack[-1].parts.append(tail)
    return root


def spoken(node: Node) -> bool:
    """Whether an element has text of its own."""
    return any(isinstance(x, str) and not x.isspace() for x in node.parts)


def ordered(root: Node) -> list[Node]:
    """Nodes that can be shown, parents first. A header is noise unless it heads an article, a control unless it stands in a sentence."""
    out, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        out.append(node)
        inside = inside or node.tag in ("article", "main")
        for x in node.parts:
            if isinstance(x, Node):
                if x.tag == "header" and not x.drop:
                    heads = any(isinstance(y, Node) and (y.tag in HEADINGS or any(isinstance(z, Node) and z.tag in HEADINGS for z in y.parts)) for y in x.parts)
                    x.noise = x.noise or not (inside and heads)
                elif x.tag in ("button", "label") and not x.drop:
                    x.noise = x.noise or not spoken(node)
                if not x.drop:
                    todo.append((x, inside))
    return out


def measured(nodes: list[Node]) -> None:
    for n in nodes:
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        n.total = 0.0
    for n in reversed(nodes):
        for x in n.parts:
            if isinstance(x, str):
                n.chars += sum(map(len, x.split()))
            elif not x.drop:
                n.chars += x.chars
                n.tags += x.tags + 1
                n.link_chars += x.link_chars
                n.link_tags += x.link_tags + (x.tag == "a")
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, max(1, n.tags)
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    ratio = body.link_chars / max(1, body.chars)
    for n in nodes:
        c, t, lc, lt = n.chars, max(1, n.tags), n.link_chars, n.link_tags
        if not c:
            n.density = 0.0
            continue
        base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
        n.density = c / t * max(0.0, math.log(max(1.0, c / max(1, lc) * (t / max(1, lt)))) / math.log(max(base, 1.0 + 1e-9)) if base > 1.0 + 1e-9 else math.log(max(1.0, c / max(1, lc) * (t / max(1, lt)))))
    for n in nodes:
        if n.up is not None:
            n.up.total += n.density


def core_of(nodes: list[Node], named: bool) -> Node:
    """The node with the largest sum of its children's densities; with names, none in noise, and noise adds nothing."""
    if not named:
        return max(nodes, key=lambda n: n.total)
    best, most, noisy = nodes[0], 0.0, set()
    for n in nodes:  # parents first
        if n.noise or id(n.up) in noisy:
            noisy.add(id(n))
            continue
        total = sum(x.density for x in n.parts if isinstance(x, Node) and not x.drop and not x.noise)
        if total > most:
            best, most = n, total
    return best


def main_text(page: str | None) -> str:
    """Blocks of the article, joined by an empty line."""
    if not page:
        return ""
    nodes = ordered(parse(page))
    measured(nodes)
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    for named in (True, False):  # a page whose names leave nothing is read without them
        text = selected(body, core_of(nodes, named), named)
        if text:
            return text
    return ""


def selected(body: Node, core: Node, named: bool) -> str:
    """The core's subtree, and beside its path to the body what is as dense as the path at least, and has dense children.

    Inside the core's article, what has more text than links stays too: there a
    short paragraph is no noise.
    """
    if not core.chars:
        core = body
    path, n, threshold = {id(core)}, core, core.density
    inside, article = set(), None
    while n is not body and n.up is not None:
        threshold = min(threshold, n.density)
        if n.tag in ("article", "main"):
            article = n
        n = n.up
        path.add(id(n))
    threshold = min(threshold, n.density)
    n = core
    while article is not None and n is not None:
        inside.add(id(n))
        n = n.up if n is not article else None
    out: list[str] = []
    todo: list[tuple[object, bool]] = [(body if id(body) in path else core, core is body)]
    while todo:
        x, whole = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.tag == "br":
            out.append(" ")
            continue
        whole = whole or x is core
        mark = "\0" if x.tag in BLOCK else ""
        out.append(mark)
        if mark:
            todo.append((mark, True))
        for y in reversed(x.parts):
            if isinstance(y, str):
                if whole or id(x) in inside or x is not body:
                    todo.append((y.replace("\0", "�"), True))
            elif y.drop or named and y.noise and id(y) not in path and y.total < core.total:
                continue
            elif whole or id(y) in path or y.density >= threshold and y.total > 0 or id(x) in inside and 2 * y.link_chars <= y.chars:
                todo.append((y, whole or id(y) not in path))
    blocks = (" ".join(entities.unescape(b).split()) for b in "".join(out).split("\0"))
    return "\n\n".join(b for b in blocks if b)


def _texts(batches):
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    small_batches(pages.sparkSession)
    return given.mapInArrow(lean(_texts), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op7_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
