"""Main text of web pages by composite text density.

Each DOM node gets its characters per tag, corrected for link characters and link tags (tags that only
format, such as b or br, don't count); a node's density sum is that of its children. The node of the
largest sum under body is the article's container, and the smallest density on its path to body is the
threshold: nodes outside the container that hang on this path belong to the text from that density on,
headings there always.

Densities decide, names only weigh. What menus, page headers and footers, sidebars, notices, adverts, forms and
reader comments are usually called divides the density of that node and of all below it by LIGHT; an article or main
element multiplies it by HEAVY, once. Such names are elements (nav, aside, ...), and on elements that only group
others a class, id or role of one such word, or a compound whose head (its last word but for `area`, `box` and
the like) is one, as in `site-footer`; other parts of compounds (`share-holders`, `related-posts`) weigh too, but
what `has` or goes `with` a part isn't one. No name weighs on inline elements, paragraphs,
preformatted text or anything else that holds running text, and hidden parts weigh like names.

Inside the container a named node goes only if what is left of its density is below the container's own and
either a third of its characters are links (half where its name is a compound, two thirds where the head isn't
such a word), or, unless only a part of its name is one, its place says so: it stands beside the container's blocks, not
within a paragraph, list or quotation, and where its name is a compound, all of the container's plain text comes
before or after it. Nothing else inside the container goes. Outside of it the same
weighed densities are compared with the threshold, so there a name can tip the balance. An article's own header
stays, as do headings. Scripts, styles, form controls and embedded objects have no text.

Cases: a null or empty page, and one without text, gives the empty text; broken markup (unclosed or
stray tags, open comments, tags cut off at the end) is parsed the way browsers recover; repeated rows are
extracted again; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
INLINE = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements without text of their own, and those that are usually no article text.
MUTE = frozenset("script style noscript template button select option textarea input iframe object embed svg canvas audio video head title".split())
ASIDE = frozenset("nav header footer aside form fieldset label menu dialog".split())
#: Elements that only group others; names weigh on these alone.
GROUPS = frozenset("div section ul ol dl table center details aside nav form".split())
#: Elements that a named node may stand in and still be beside the container's blocks.
AROUND = frozenset("div section center details aside nav form article main body html #root header footer".split())
#: Last words of compounds that say nothing of their own.
GENERIC = frozenset("area bar block box container content group holder inner item items list panel section wrap wrapper".split())
#: How much a name takes from a density, and what an article or main element adds to it.
LIGHT, HEAVY = 20.0, 10.0
#: Words of class, id and role attributes for what is usually no article text.
NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies disqus "
    "dropdown footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup "
    "promo promoted promotion related reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar widget widgets "
    "contentinfo complementary".split()
)
_TAG = re.compile(r"<!--(?:>|->|.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_HINT = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=$|[\s=/])|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
#: Words of compounds that say whether a page has such a part, not that the node is one.
_ABOUT = frozenset("has with no without".split())
#: What says that a node is noise: nothing, a part of a compound, its head, a whole name or an element, being hidden.
PLAIN, PART, COMPOUND, WHOLE, HIDDEN = range(5)
_ENDS_P = BLOCK
_SELF = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
_SCOPE = frozenset("table td th html body template".split())


class Node:
    __slots__ = ("chars", "children", "density", "link_chars", "link_tags", "noise", "parent", "sum", "tag", "tags", "weight")

    def __init__(self, tag: str, parent: Node | None, weight: float = 1.0, noise: int = PLAIN):
        self.tag, self.parent, self.weight, self.noise = tag, parent, weight, noise
        self.children: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def noise_of(tag: str, attributes: str) -> int:
    """What a node's element and names say about it."""
    if tag in HEADINGS or tag in ("html", "body"):
        return PLAIN
    if tag in ASIDE:
        return WHOLE
    if not attributes.strip():
        return PLAIN
    if _HIDDEN.search(attributes):
        return HIDDEN
    if tag not in GROUPS:
        return PLAIN
    found = PLAIN
    for m in _HINT.finditer(attributes):
        for name in m[1].lower().strip("\"'").split():
            words = _WORDS.findall(name)
            compound = len(words) > 1
            while len(words) > 1 and words[-1] in GENERIC:
                words.pop()
            if any(w in NOISE_WORDS and (not i or words[i - 1] not in _ABOUT) for i, w in enumerate(words)):
                head = words[-1] in NOISE_WORDS and not _ABOUT & {*words}
                found = max(found, PART if not head else COMPOUND if compound else WHOLE)
    return found


def weight_of(tag: str, noise: int, parent: Node) -> float:
    """By how much a node's density counts more or less than its parent's."""
    if noise:
        return 1 / LIGHT
    if tag in ("article", "main"):
        while parent is not None and parent.tag not in ("article", "main"):
            parent = parent.parent
        return 1.0 if parent else HEAVY
    return 1.0


def parse(page: str) -> Node:
    """The DOM; text nodes are strings among the children."""
    root = Node("#root", None)
    open_, at, end = root, 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            open_.children.append(page[at:])
            break
        if m.start() > at:
            open_.children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3] or ""
        if m[1]:
            node = open_
            while node is not root and node.tag != tag and not (node.tag in _SCOPE and tag not in ("table", "html", "body", "tr")):
                node = node.parent
            if node is not root and node.tag == tag and tag not in ("html", "body"):
                open_ = node.parent
            continue
        if tag in _ENDS_P:
            node = open_
            while node is not root and node.tag != "p" and node.tag not in BLOCK and node.tag not in _SCOPE:
                node = node.parent
            if node.tag == "p":
                open_ = node.parent
        if tag in _SELF:
            ends, stops = _SELF[tag]
            node = found = open_
            found = None
            while node is not root and node.tag not in stops:
                if node.tag in ends:
                    found = node
                node = node.parent
            if found:
                open_ = found.parent
        noise = noise_of(tag, attributes)
        node = Node(tag, open_, weight_of(tag, noise, open_) * open_.weight, noise)
        open_.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not (attributes.rstrip().endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "span", "td", "th")):
            open_ = node
    return root


def _walk(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    return order


def measure(root: Node) -> Node:
    """Fill in counts, densities and sums; returns body (root where there is none)."""
    order = _walk(root)
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(" ".join(c.split()))
            elif c.tag not in MUTE:
                node.chars += c.chars
                node.tags += c.tags + (c.tag not in INLINE)
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
        elif node.tag == "header" and node.parent is not None and node.parent.tag in ("article", "main", "section") and node.weight < node.parent.weight:
            for below in _walk(node):  # an article's own header
                below.weight *= LIGHT
    body = next((n for n in order if n.tag == "body"), root)
    ratio = body.link_chars / max(body.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if c and node.tag not in MUTE:
            base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
            node.density = c / t if base <= 1.000001 else c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / math.log(base)
    for node in order:
        node.sum = sum(c.density * c.weight for c in node.children if isinstance(c, Node) and c.tag not in INLINE)
    return body


def container(body: Node) -> list[Node]:
    """The node of the largest density sum, the first of equals, and its ancestors up to body."""
    best = max((n for n in _walk(body) if n.tag not in MUTE), key=lambda n: n.sum)
    path = [best if best.sum else body]
    while path[-1] is not body:
        path.append(path[-1].parent)
    return path


def blocks(path: list[Node]) -> list[str]:
    """The text of the container's blocks (the path's first node) and of what hangs on its path, in page order."""
    best, on_path = path[0], {id(n) for n in path}
    threshold = min(n.density for n in path)
    out: list[str] = []
    run: list[str] = []
    places: dict[int, int] = {}  # of the container's nodes, in page order
    plain: list[int] = []  # how many of them have begun before each plain text

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    def beside(node: Node) -> bool:
        """Whether it stands beside the container's blocks."""
        above = node.parent
        while id(above) not in on_path:
            if above.tag not in AROUND:
                return False
            above = above.parent
        return True

    def at_edge(node: Node) -> bool:
        """Whether all plain text of the container comes before or all of it after the node."""
        if not places:
            inside = [(best, False)]
            while inside:
                item, named = inside.pop()
                if isinstance(item, str):
                    plain.append(len(places)) if item.strip() and not named else None
                    continue
                named = named or (item is not best and item.noise > PLAIN and item.weight < best.weight)
                places[id(item)] = len(places)
                inside += [(c, named) for c in reversed(item.children) if isinstance(c, str) or c.tag not in MUTE]
        at = places.get(id(node))
        return at is None or not plain or at >= plain[-1] or at < plain[0]

    def kept(node: Node, base: float) -> bool:
        """base: the weight of its closest ancestor on the path."""
        if node.tag in MUTE or id(node) in on_path:
            return node.tag not in MUTE
        below_path = id(node.parent) in on_path and node.parent is not best
        if node.noise and node.weight < base:
            if below_path:
                return node.density * node.weight / base >= threshold
            if node.density * node.weight / base >= max(threshold, best.density):
                return True
            if node.noise == HIDDEN:
                return False
            links = node.link_chars / max(node.chars, 1)
            if node.noise == PART:
                return links < 2 / 3
            if node.noise == COMPOUND:
                return links < 1 / 2 and not (beside(node) and at_edge(node))
            return links < 1 / 3 and not beside(node)
        return not below_path or node.tag in HEADINGS or node.tag in INLINE or node.density >= threshold

    todo: list = [(path[-1], False, 1.0)]
    while todo:
        item, done, base = todo.pop()
        if isinstance(item, str):
            run.append(item)
        elif done:
            flush()
        elif not kept(item, base):
            if item.tag in BLOCK:
                flush()
        else:
            if item.tag in ("br", "td", "th", "wbr"):
                run.append(" ")
            if item.tag in BLOCK:
                flush()
                todo.append((item, True, base))
            base = item.weight if id(item) in on_path else base
            todo += [(c, False, base) for c in reversed(item.children)]
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of a page, its blocks joined by newlines."""
    if not page or not page.strip():
        return ""
    return "\n".join(blocks(container(measure(parse(page)))))


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, SCHEMA)
