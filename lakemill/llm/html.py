"""Main text of web pages by tree scoring (operator 2)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article body div main section td blockquote".split())
LISTS = frozenset("ul ol dl table figure".split())
#: Elements that never hold main text.
NEVER = frozenset("nav footer aside form button select option input menu dialog head search fieldset datalist object audio video canvas map annotation annotation-xml".split()) | RAW
#: Elements that close an open paragraph.
CLOSES_P = BLOCKS - frozenset("caption td th tr tbody thead tfoot head body html".split())
#: Siblings that an opening tag closes, up to the given ancestors.
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr td th", "table"), "option": ("option", "select")}
#: Words of a class or id that mark what is not main text, and what is.
BAD = re.compile(r"(?i)(^|[\s_-])(ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|disclaimer|footer|foot|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|related|replies|respond|rss|share|sharing|shoutbox|sidebar|side|skyscraper|social|sponsor\w*|subscribe|tags|toolbar|widget)(?=$|[\s_-])")
GOOD = re.compile(r"(?i)(^|[\s_-])(article|body|content|entry|hentry|main|page|post|story|text)(?=$|[\s_-])")
#: Of these words, those that prose may have in a class of its own: inside an article they need more signs (``_weak``).
WEAK = frozenset("ad banner disclaimer foot notice notices pager related replies respond share side social tags".split())
#: Words that say of what kind a marked block is, not what it is about.
SHAPES = frozenset("area bar block body box buttons column container icons inner item items links list media module panel posts row section site top wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_SPACE = re.compile(r"[\x20\t\n\v\f\r]+")
_BEGIN = re.compile(r"<(?=[!?]|/?[a-zA-Z])")
_OTHER = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.DOTALL)
_TAG = re.compile(r"</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.DOTALL)
_BARE = re.compile(r"</?[a-zA-Z][^>]*>", re.DOTALL)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: An attribute with its value, quoted values whole, so that nothing inside of one is taken for an attribute.
_ATTRIBUTE = re.compile(r"[\s/]+([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*))?")


#: Where the text of such an element ends; the tag's own end is looked for once, so the search is linear.
_ENDS = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in RAW}

#: Elements that a head may hold; any other tag, or text, ends it.
IN_HEAD = frozenset("html head title meta link script style base noscript template basefont bgsound".split())
#: So many blocks up, elements are looked for that an opening tag closes.
REACH = 64


class Node:
    """An element. ``block`` is the nearest block, itself included; ``open`` counts the inline elements that are open in a block."""

    __slots__ = ("tag", "parent", "children", "hint", "score", "length", "linked", "commas", "block", "open", "within")

    def __init__(self, tag: str, parent: Node | None, hint: int):
        self.tag, self.parent, self.hint = tag, parent, hint
        self.open: dict[str, int] | None = {} if parent is None or tag in BLOCKS else None
        self.block: Node = self if self.open is not None else parent.block
        #: inside an article or main element, which has told already what is main text
        self.within: bool = parent is not None and (parent.within or parent.tag in ("article", "main"))
        self.children: list[Node | str] = []
        self.score = 0.0
        self.length = self.linked = self.commas = 0


def attributes(source: str) -> dict[str, str]:
    """The attributes of a tag, names in lower case; of repeated ones the first."""
    found: dict[str, str] = {}
    if " " in source or "\n" in source or "\t" in source or "/" in source:
        for name, value in _ATTRIBUTE.findall(source, _NAME.match(source).end()):
            found.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return found


def _weak(names: str) -> bool:
    """Whether the class and id of a block inside an article leave open that it is prose: its bad words are weak ones, or parts of longer words, and it has others."""
    marked = [x for x in names.lower().split() if BAD.search(x)]
    parts = [re.split(r"[_-]+", x) for x in marked]
    if any(BAD.fullmatch(w) and w not in WEAK for x in parts for w in x):
        return False
    others = [x for x in names.split() if not BAD.search(x) and x.lower() not in SHAPES]
    return bool(others) or any(not BAD.fullmatch(w) and w not in SHAPES for x in parts for w in x)


def _hint(tag: str, source: str, within: bool) -> int:
    """-1: not main text by its name, class, id, role or because it is hidden; -2: so by its class, if its text agrees; 1: a good sign; 0: neither."""
    if tag in NEVER:
        return -1
    found = attributes(source)
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES or re.search(r"(?i)display\s*:\s*none", found.get("style", "")):
        return -1
    if tag not in ("html", "body", "article", "main") and BAD.search(names):
        return -2 if within and _weak(names) else -1
    return int(tag in ("article", "main") or bool(GOOD.search(names)))


def tags(source: str) -> Iterator[tuple[str, str, int]]:
    """(text, tag, where the tag ends) in turn, in linear time; the last tag is empty. ``send`` gives a place to go on from.

    A quote that is never closed ends the care for quotes: from there on a tag ends at the next bracket.
    """
    at, n, careful = 0, len(source), True
    while True:
        begin = _BEGIN.search(source, at)
        found = None
        if begin:
            if source[begin.end()] in "!?":
                found = _OTHER.match(source, begin.start())
            else:
                found = _TAG.match(source, begin.start()) if careful else None
                if not found:
                    careful = False
                    found = _BARE.match(source, begin.start())
        if not found:  # no bracket is left to end a tag
            yield source[at:], "", n
            return
        text, at = source[at : found.start()], found.end()
        at = (yield text, found[0], at) or at


def parse(source: str) -> Node:
    """The element tree, in linear time. Unclosed and crossing tags are mended: blocks close paragraphs, a head ends with the first body tag, an end tag without a start is left out."""
    root = node = Node("html", None, 0)
    n, head = len(source), None
    blocks_open: dict[str, int] = {}

    def left(x: Node, up: Node) -> Node:
        """``up``, after the elements from ``x`` to below it were closed."""
        while x is not up:
            counts = blocks_open if x.open is not None else x.block.open
            counts[x.tag] -= 1
            x = x.parent
        return up

    stream, jump = tags(source), None
    while True:
        try:
            text, tag, at = stream.send(jump)
        except StopIteration:
            return root
        jump = None
        if head is not None and node is head and text.strip():
            node, head = left(node, head.parent), None
        if text:
            node.children.append(html.unescape(text))
        name = _NAME.match(tag)
        if not name:
            if tag.startswith("<![CDATA["):
                node.children.append(tag[9:].removesuffix("]]>"))
            continue
        name = name[1].lower()
        if tag[1] == "/":
            if (blocks_open if name in BLOCKS else node.block.open).get(name):
                up = node
                while up.tag != name or up is root:
                    up = up.parent
                node = left(node, up.parent)
                head = None if name == "head" else head
            continue
        if name in ("html", "body") and node is root:
            continue
        if head is not None and name not in IN_HEAD:
            node, head = left(node, head.parent), None
            if name == "body":
                continue
        if name in CLOSES_P and node.block.tag == "p":
            node = left(node, node.block.parent)
        if name in CLOSES:
            closed, stops = (x.split() for x in CLOSES[name])
            up, last, reach = node.block if name != "option" else node, None, REACH
            while up is not root and up.tag not in stops and reach:
                last = up if up.tag in closed else last
                up, reach = (up.parent.block if name != "option" else up.parent), reach - 1
            node = left(node, last.parent) if last else node
        if name in HEADINGS and node.tag in HEADINGS:
            node = left(node, node.parent)
        new = Node(name, node, 0)
        new.hint = _hint(name, tag, new.within)
        node.children.append(new)
        if name in RAW:
            end = _ENDS[name].search(source, at)
            jump = (source.find(">", end.end()) + 1 or n) if end else n
        elif name not in VOID and not tag.endswith("/>"):
            counts = blocks_open if new.open is not None else new.block.open
            counts[name] = counts.get(name, 0) + 1
            node, head = new, new if name == "head" else head


def _measure(node: Node, in_link: bool) -> None:
    """Lengths, linked lengths and commas of all subtrees, bottom up and without recursion."""
    order, stack = [], [(node, in_link)]
    while stack:
        x, linked = stack.pop()
        linked = linked or x.tag == "a"
        order.append((x, linked))
        stack.extend((y, linked) for y in x.children if isinstance(y, Node) and y.hint != -1)
    for x, linked in reversed(order):
        for y in x.children:
            if isinstance(y, str):
                size = len(_SPACE.sub(" ", y).strip())
                x.length += size
                x.linked += size * linked
                x.commas += y.count(",")
            elif y.hint >= 0:
                x.length, x.linked, x.commas = x.length + y.length, x.linked + y.linked, x.commas + y.commas
        if x.hint == -2:  # a weak sign: links decide
            x.hint = -1 if not x.length or density(x) >= 0.5 else 0


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _nodes(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(y for y in reversed(x.children) if isinstance(y, Node) and y.hint >= 0)


def best_containers(root: Node) -> list[Node]:
    """The article, or else main element around the container of highest score; without one, the container and those siblings that belong to it, in page order.

    Each paragraph has 1 point, one for each comma and one for each 100 characters, at most 3, discounted by its link
    density. All of it goes to its parent, half to the one above, a third of it to the next and so on. Sums are
    discounted by the container's link density; an article or main element and a telling class count a half more.
    """
    _measure(root, False)
    for x in _nodes(root):
        if x.tag in PARAGRAPHS and x.length and not any(isinstance(y, Node) and y.tag in PARAGRAPHS for y in x.children):
            points = (1 + x.commas + min(x.length // 100, 3)) * (1 - density(x))
            up, depth = x.parent, 1
            while up is not None and depth <= 4:
                up.score += points / depth
                up, depth = up.parent, depth + 1
    ranked = {id(x): x.score * (1 - density(x)) * (1.5 if x.hint > 0 else 1) for x in _nodes(root)}
    top = max((x for x in _nodes(root) if x.tag in CONTAINERS or x is root), key=lambda x: ranked[id(x)])
    if not ranked[id(top)]:
        return [root]
    for tag in ("article", "main"):
        up = top
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None:
            return [up]
    if top.parent is None:
        return [top]
    out = []
    for x in top.parent.children:
        if isinstance(x, Node) and x.hint >= 0:
            joined = ranked[id(x)] >= max(10.0, 0.2 * ranked[id(top)]) and x.tag in CONTAINERS
            prose = x.tag in PARAGRAPHS and (x.length > 80 and density(x) < 0.25 or 0 < x.length <= 80 and not x.linked and x.commas + (x.tag in HEADINGS) > 0)
            listed = x.tag in LISTS and x.length and density(x) < 0.25
            short = x.tag in CONTAINERS and x.length and not x.linked and _holds_prose(x)
            if x is top or joined or prose or listed or short:
                out.append(x)
    return out


def _holds_prose(node: Node) -> bool:
    """Whether all text of a container without links stands in paragraphs or headings, as a short last section's or a title's does."""
    stack: list[Node] = [node]
    while stack:
        x = stack.pop()
        for y in x.children:
            if isinstance(y, str):
                if y.strip():
                    return False
            elif y.hint >= 0 and y.tag not in PARAGRAPHS:
                stack.append(y)
    return True


def blocks(node: Node) -> list[str]:
    """Texts of the blocks of a subtree in page order, white space as one space."""
    out: list[str] = []
    parts: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(parts).replace("\xa0", " ")).strip(" ")
        parts.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            parts.append(x)
        elif x.hint < 0 and x is not node:
            parts.append(" " if x.tag not in BLOCKS else "")
        elif x.tag == "br":
            parts.append(" ")
        elif x.tag in BLOCKS:
            end()
            stack.append(None)
            stack.extend(reversed(x.children))
        else:
            stack.extend(reversed(x.children))
    end()
    return out


def main_text(source: str | None) -> str:
    """The article of a page as blocks joined by newlines; empty for null, empty or textless pages."""
    if not source:
        return ""
    return "\n".join(y for x in best_containers(parse(source)) for y in blocks(x))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, whole and without a shuffle.

    A null page is an empty one; null ids and urls, repeated rows and further columns don't matter, very long pages are
    taken whole, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 512):
                b = whole.slice(lo, 512)
                texts = [main_text(x) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0)]), pa.concat_arrays([b.column(1)]), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)[id_col]
    return pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
