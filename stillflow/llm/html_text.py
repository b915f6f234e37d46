r"""HTML extraction by composite text density.

A page becomes a tree of elements. Every node has its characters per tag, adjusted for how much of it is links (composite
text density), and its density sum, the sum over its children. The subtree with the largest sum is the article. Beside
the path from the body to it, what reaches a threshold belongs to it too: the least density on that path, but at least
SHARE of the article's own. Where one child made of blocks has BULK of the sum (an article of one paragraph), that child
is taken in its parent's place; within an article element, the element.

Nothing but what a browser does not show (scripts, styles, hidden elements) is left out beforehand. What HTML marks as
something else (nav, aside, footer, form, ...), or a class or id names so, weighs LIGHT of its density; it is left out if
it stands beside or in the article, unless it is as dense as the article even so. A named wrapper with the article in it
weighs all of it alike, so it loses nothing. A class or id names an element if the whole of a word is a name, or all its
parts are names and words of position: 'has-sidebar' and 'related-work' name nothing. A page whose densest text is within
a closed nav, aside, footer or the like has no article.

Text is joined as read: character references decoded, white space inside a block one space, blocks joined by one space.

Defined cases. A null or empty page, and one without an article, gives the empty text. Very long pages are read whole, in
time that grows with their length, whatever their markup; elements nested deeper than DEEPEST stand beside one another,
as in browsers. Broken markup is read as browsers do: unclosed elements end with their parents, a < that begins no tag is
text, a tag that never ends is dropped with what follows. Of equal density sums (ties) the first in page order counts.
Rows are read one by one, so repeated rows give repeated results; an empty table gives an empty result. Columns other
than html are passed through; added columns replace those of their names.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from stillflow.llm.common import batches, widened

# Fixed values of HTML: elements without content, whose content is not markup, that are blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
# What ends an element of the key that is still open, within its own parent.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot article section main body html div".split())
# Elements, roles and words in class or id that mark what is not the article.
MARKED_TAGS = frozenset("nav footer aside dialog menu search head".split())
CONTROL_TAGS = frozenset("form fieldset label button select option datalist object audio video canvas svg math noscript template".split())
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices notification alert nav navbar navigation menu menus sidebar sidebars breadcrumb breadcrumbs comment comments commentlist respond reply replies disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay footer masthead toolbar pagination pager widget widgets skip".split()
)
EXEMPT = frozenset("html body main article".split())
# Words beside those in a class or id that do not change what it names.
POSITIONS = frozenset("site page top bottom left right inner outer box area bar block container wrapper wrap list item items link links post posts article articles story stories section slot unit form thread primary secondary global mobile desktop".split())
#: Kinds of elements: marked by HTML, named by class, id or as a form's part; 0 is neither.
MARKED, NAMED = 1, 2
#: The part of its density that a marked or named element counts with.
LIGHT = 0.01
#: Of the article's density, what stands beside it must reach; of a sum, a child must have to stand for all.
SHARE, BULK = 0.4, 0.7
DEEPEST = 512

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"']++)))?")
_TELLING = re.compile(r"class|id|role|hidden", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
_ZEROS = re.compile(r"&#([xX]?)0{8,}")
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "depth", "kind", "hidden", "closed", "weight", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children, self.parts, self.kind, self.hidden, self.closed = tag, parent, [], [], 0, False, False
        self.depth = 0 if parent is None else parent.depth + 1
        if parent is not None:
            parent.children.append(self)
            parent.parts.append(self)


def decoded(text: str) -> str:
    """The text with its character references decoded; numbers beyond all characters become the replacement character."""
    if "&#" in text:
        text = _HUGE.sub("�", _ZEROS.sub(r"&#\g<1>0", text))
    return references.unescape(text) if "&" in text else text


def names_other(value: str, inside_article: bool) -> bool:
    """Whether a class or id names what is not the article."""
    for token in value.lower().split():
        words = _WORDS.findall(token)
        other = [w for w in words if w in NAMES or (w == "header" and not inside_article)]
        if other and (len(words) == 1 or all(w in other or w in POSITIONS or w.isdigit() for w in words)):
            return True
    return False


def _describe(x: Node, attributes: str, inside_article: bool) -> None:
    """Sets the kind of an element, and whether it is hidden."""
    if x.tag in MARKED_TAGS or (x.tag == "header" and not inside_article):
        x.kind = MARKED
    elif x.tag in CONTROL_TAGS:
        x.kind = NAMED
    if x.tag in EXEMPT or not _TELLING.search(attributes):
        return
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            x.hidden = True
        elif name == "role" and value.strip().lower() in MARKED_ROLES:
            x.kind = MARKED
        elif not x.kind and ((name in ("class", "id") and names_other(value, inside_article)) or (name == "aria-hidden" and value == "true")):
            x.kind = NAMED


def parse(page: str) -> Node:
    """The tree of a page; text parts are decoded strings among a node's parts."""
    root = node = Node("html", None)
    opened: Counter[str] = Counter()
    at, size = 0, len(page)

    def end(to: Node) -> Node:
        """Ends all elements from the open one up to and including to."""
        x = node
        while True:
            opened[x.tag] -= 1
            if x is to:
                return x.parent
            x = x.parent

    while at < size and (begin := page.find("<", at)) >= 0:
        if begin > at:
            node.parts.append(decoded(page[at:begin]))
        first = page[begin + 1 : begin + 2]
        if first in "!?" and first:
            ends = "-->" if page.startswith("<!--", begin) else ">"
            stop = page.find(ends, begin + 2)
            at = size if stop < 0 else stop + len(ends)
            continue
        m = _TAG.match(page, begin)
        if m is None:
            second = page[begin + 2 : begin + 3]
            if (first.isascii() and first.isalpha()) or (first == "/" and second.isascii() and second.isalpha()):
                at = size  # a tag that never ends
            elif first == "/" and second:
                stop = page.find(">", begin)
                at = size if stop < 0 else stop + 1
            else:
                node.parts.append("<")
                at = begin + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                Node("br", node)
            elif opened[tag] > 0:
                x = node
                while x.tag != tag:
                    x = x.parent
                x.closed = True
                node = end(x)
            continue
        if tag == "html":
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if opened["p"] > 0 and tag in BLOCKS and tag != "br":
            x = node
            while x is not None and x.tag != "p" and x.tag not in BLOCKS:
                x = x.parent
            if x is not None and x.tag == "p":
                node = end(x)
        if tag in ENDS and any(opened[t] > 0 for t in ENDS[tag]):
            x = node
            while x is not None and x.tag not in ENDS[tag] and x.tag not in SCOPES:
                x = x.parent
            if x is not None and x.tag in ENDS[tag]:
                node = end(x)
        new = Node(tag, node)
        _describe(new, m[3], opened["article"] + opened["main"] > 0)
        empty = tag in VOID or (tag in ("svg", "math") and m[3].rstrip().endswith("/"))
        if not empty and new.depth < DEEPEST:
            node = new
            opened[tag] += 1
    if at < size:
        node.parts.append(decoded(page[at:]))
    return root


def in_order(root: Node) -> list[Node]:
    """Nodes that are shown, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(c for c in reversed(x.children) if not c.hidden)
    return out


def _weigh(nodes: list[Node]) -> None:
    """Weights of nodes: LIGHT for each marked or named one that they are in. The page's only articles are not light for a name around them."""
    for x in nodes:
        x.weight = max(LIGHT**4, (LIGHT if x.kind else 1.0) * (1.0 if x.parent is None else x.parent.weight))
    articles = [x for x in nodes if x.tag in ("article", "main")]
    if any(x.weight == 1 for x in articles):
        return
    marked: set[int] = set()
    for x in nodes:
        if x.kind == MARKED or id(x.parent) in marked:
            marked.add(id(x))
        elif x.tag in ("article", "main"):
            x.weight = 1.0
        elif x.parent is not None:
            x.weight = max(LIGHT**4, (LIGHT if x.kind else 1.0) * x.parent.weight)


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_links: float) -> float:
    """Composite text density: characters per tag, lowered by links among characters and tags. body_links: the body's share of them."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * links + body_links * chars + math.e)
    return chars / tags * math.log(max(1.0, chars / links * tags / link_tags)) / math.log(base)


def measure(nodes: list[Node], body: Node) -> None:
    """Counts, densities and density sums of nodes (the shown ones below body, in page order)."""
    for x in reversed(nodes):
        x.chars = x.link_chars = x.tags = x.link_tags = 0
        for p in x.parts:
            if isinstance(p, str):
                x.chars += len(" ".join(p.split()))
            elif not p.hidden:
                x.chars += p.chars
                x.tags += 1 + p.tags
                x.link_chars += p.link_chars
                x.link_tags += p.link_tags
        if x.tag == "a":
            x.link_chars = x.chars
            x.link_tags += 1
    body_links = body.link_chars / max(1, body.chars)
    for x in nodes:
        x.density = x.weight * density(x.chars, x.tags, x.link_chars, x.link_tags, body_links)
    for x in nodes:
        x.sum = sum(c.density for c in x.children if not c.hidden)


def _shown(x: Node) -> list[Node]:
    return [c for c in x.children if not c.hidden]


def _densest(nodes: list[Node], body: Node) -> Node:
    """The subtree with the largest density sum, or the article element around it."""
    top = max(nodes, key=lambda x: x.sum)
    while not any(isinstance(p, str) and p.strip() for p in top.parts):
        bulk = max((c for c in _shown(top) if c.tag in BLOCKS), key=lambda c: c.density, default=None)
        if bulk is None or not bulk.density or bulk.density < BULK * top.sum or not any(c.density and c.tag in BLOCKS for c in _shown(bulk)):
            break
        top = bulk
    x = top
    while x is not body:
        if x.tag == "article":
            top = x
        x = x.parent
    return top


def _beside(path: list[Node], top: Node) -> set[int]:
    """Children of the nodes on the path (from the article's parent up) that belong to the article, and the path's nodes whose own text does."""
    least = max(min(p.density for p in [top, *path]), SHARE * top.density)
    found, on = set(), top
    for p in path:
        if p.density >= least:
            found.add(id(p))
        row = [c for c in _shown(p) if c.chars or c is on]
        fits = [c is on or (c.weight >= top.weight and c.density >= least and 2 * c.link_chars < c.chars) for c in row]
        ends = [i for i, f in enumerate(fits) if f]
        for i, c in enumerate(row):
            between = ends[0] < i < ends[-1] and c.weight >= top.weight and 2 * c.link_chars < c.chars
            if c is not on and (fits[i] or between):
                found.add(id(c))
        # Headings right before it.
        for c in reversed(row[: ends[0]]):
            if c.tag not in HEADINGS or c.weight < top.weight:
                break
            found.add(id(c))
        on = p
    return found


def main_text(page: str | None) -> str:
    """The article's text of a page."""
    if not page:
        return ""
    root = parse(page)
    body = next((x for x in in_order(root) if x.tag == "body"), root)
    # What stands after the body's end, or before its beginning, is the body's as well.
    body = root if any((isinstance(p, str) and p.strip()) or (not isinstance(p, str) and p.tag not in ("head", "body")) for p in root.parts) else body
    nodes = in_order(body)
    _weigh(in_order(root))
    measure(nodes, body)
    if not body.chars:
        return ""
    top = _densest(nodes, body)
    x = top
    while x is not None:
        if x.kind == MARKED and x.closed:
            return ""
        x = x.parent
    path, x = [], top
    while x is not body:
        x = x.parent
        path.append(x)
    beside = set() if top.tag == "article" else _beside(path, top)
    on_path = {id(p) for p in path}
    out: list[str] = []
    # (node, whether all of it is content); page order.
    stack: list = [(body, top is body)]
    while stack:
        x, inside = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        edge = " " if x.tag in BLOCKS else ""
        items: list = [edge]
        for p in x.parts:
            if isinstance(p, str):
                if inside or id(x) in beside:
                    items.append(p)
                continue
            content = (inside or id(p) in beside) and not p.hidden
            if content and p.weight < top.weight and p.density < top.density:
                content = False
            elif content and top is body and 2 * p.link_chars >= p.chars and p.density < body.density and p.tag in BLOCKS:
                content = False  # the page has no container of its own for the article: lists of links are under its threshold
            if p is top or content:
                items.append((p, True))
            elif id(p) in on_path:
                items.append((p, False))
            elif p.tag in BLOCKS:
                items.append(" ")
        items.append(edge)
        stack.extend((i, inside) if isinstance(i, str) else i for i in reversed(items))
    return " ".join("".join(out).split())


def extract(pages: DataFrame) -> DataFrame:
    """pages without html, and text, n_chars (code points) of each page's article."""
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    source = pages.select(*kept, pages["html"].cast("string").alias("html"))

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    return source.mapInArrow(run, widened(source.drop("html").schema, text="string", n_chars="long"))
