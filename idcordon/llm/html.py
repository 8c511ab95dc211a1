"""Main text of web pages by tree scoring.

The markup is read into a tree. Every paragraph gives points for its length and its commas to
its parent, half of them to its grandparent and less to those above; what stands in links
counts against a container. The container with most points and those of its neighbours that have enough points of
their own are the article. An article or main element has a lead of points; it takes the place of the best container
inside it if that has a good part of its text.

Menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and
reader comments are left out by their element, role, or a class or id that says nothing else (``ad-box``,
``comments``), unless they hold the page's article itself or all of its text. A name in which such a word is one among others
(``side-effects``, ``menu-of-the-day``) takes points away, and the element goes only if most of its text are links.

Defined results: null, empty or blank html gives an empty text. Broken markup is read as far as
it can be: open elements end with the page, stray end tags don't count, a comment or script
without an end takes the rest. A page without paragraphs gives the text of its body that isn't
left out. Repeated rows are extracted alike; extra columns are not read. No text is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the markup language.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split()
)
_ENDS_P = _BLOCKS - {"body", "html", "legend", "option", "tbody", "tfoot", "thead", "tr", "li", "dd", "dt"}
_SPACED = frozenset(["br", "td", "th", "img"])
# An element of the first kind ends an open one of the second kinds, up to the third.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}

# What is left out: by element, by role, by words of class and id.
_LEFT_TAGS = frozenset("nav footer aside form button select input label fieldset dialog menu search object canvas audio video datalist".split())
_LEFT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_LEFT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion promoted nav navbar navigation menu "
    "breadcrumb breadcrumbs footer sidebar side aside comment comments reply replies disqus respond cookie cookies consent gdpr notice notices "
    "banner popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "pagination pager widget widgets toolbar masthead topbar alert skip hidden outbrain taboola".split()
)
# Words of a name that only say where or how big a thing is, or of what page it is.
_PLAIN_WORDS = frozenset(
    "box container wrapper wrap holder block section area unit slot list item items link links button buttons bar left right top bottom inner "
    "outer center row col column grid panel pane group text title content post posts article entry story page site main blog primary secondary "
    "global mobile desktop form header".split()
)
_HEADER_WORDS = frozenset(["header", "head"])
_OWN_WORDS = frozenset("article entry post story content title".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


class Node:
    __slots__ = ("tag", "parent", "children", "words", "names", "role", "gone", "holds", "points", "text", "linked")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.words, self.names, self.role, self.gone = frozenset(), (), "", False
        self.holds, self.points, self.text, self.linked = False, 0.0, 0, 0
        if attributes and not attributes.isspace():
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        names = []
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id", "itemprop"):
                names.append(value)
            elif name == "role":
                self.role = value.strip().lower()
            elif name == "style":
                self.gone |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            else:
                self.gone |= name == "hidden" or value.lower() == "true"
        if names:
            each = (frozenset(w.lower() for w in _WORD.findall(n) if not w.isdigit()) for n in " ".join(names).split())
            self.names = tuple(n for n in each if n)
            self.words = frozenset().union(*self.names)


def parse(html: str) -> Node:
    root = Node("#page", None)
    at, here, lower = 0, root, None
    while True:
        m = _MARKUP.search(html, at)
        if m is None:
            here.children.append(html[at:])
            return root
        if m.start() > at:
            here.children.append(html[at : m.start()])
        at = m.end()
        end, tag = m[1], m[2]
        if end:
            end = end.lower()
            up = here
            while up is not root and up.tag != end:
                up = up.parent
            if up is not root:
                here = up.parent
            elif end == "p":
                here.children.append(Node("p", here))
            elif end == "br":
                here.children.append(Node("br", here))
        elif tag:
            tag = tag.lower()
            here = _closed(tag, here, root)
            node = Node(tag, here, m[3])
            here.children.append(node)
            if tag in _RAW:
                lower = html.lower() if lower is None or len(lower) != len(html) else lower
                stop = lower.find(f"</{tag}", at)
                stop = len(html) if stop < 0 else stop
                at = html.find(">", stop) + 1 or len(html)
            elif tag not in _VOID and not (m[3] or "").endswith("/"):
                here = node
            elif tag not in _VOID and tag in _BLOCKS:
                here = node


def _closed(tag: str, here: Node, root: Node) -> Node:
    """Where a new element goes: elements that it ends are closed."""
    kinds = ({"p"}, {"td", "th", "button", "object", "table", "caption"}) if tag in _ENDS_P else _SIBLINGS.get(tag)
    if not kinds:
        return here
    ends, bounds = kinds
    up, out = here, here
    while up is not root and up.tag not in bounds:
        if up.tag in ends:
            out = up.parent
            if tag in _ENDS_P:
                break
        up = up.parent
    return out


# ---------------------------------------------------------------- what is left out


def _own(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role == "main" or "body" in node.words and "article" in node.words


def _says_only(node: Node, words: frozenset[str]) -> bool:
    """Whether a class or id of the element holds some of the words and besides only plain ones."""
    return any(n & words and not n - words - _PLAIN_WORDS for n in node.names)


def _marked(node: Node) -> bool:
    """Left out by its names, whatever it holds."""
    return _says_only(node, _LEFT_WORDS) or node.role in _LEFT_ROLES


def _leave_out(root: Node) -> list[Node]:
    """Takes out what isn't of the article; returns what went by its names."""
    named: list[Node] = []
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if type(c) is Node]
    for node in reversed(order):
        marked = _marked(node)
        if (node.tag == "h1" or _own(node)) and not marked:
            node.holds = True
        if node.holds and node.parent is not None and node.tag not in _LEFT_TAGS and node.tag != "header":
            node.parent.holds = True
    for node in order:
        if node.tag in ("#page", "html", "body") or node.gone:
            continue
        inside = node.parent
        while inside is not None and not _own(inside):
            inside = inside.parent
        if node.tag in _RAW or node.tag == "head" or node.tag in _LEFT_TAGS:
            node.gone = True
        elif _marked(node):
            node.gone = not node.holds
            named += [node] if node.gone else []
        elif node.tag == "header" or _says_only(node, _HEADER_WORDS) and not node.words & _OWN_WORDS and node.tag not in _HEADINGS:
            # Of an article's own header the headings stay.
            if inside is None:
                node.gone = not any(_own(c) for c in _elements(node))
            elif node.tag == "header":
                node.children = [c for c in _elements(node) if c.tag in _HEADINGS]
    return named


def _elements(node: Node) -> list[Node]:
    out, stack = [], [c for c in reversed(node.children) if type(c) is Node]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [c for c in reversed(x.children) if type(c) is Node]
    return out


# ---------------------------------------------------------------- scoring


def _score(root: Node) -> list[Node]:
    """Gives every element its points and takes out doubtful lists of links; returns the containers with points."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        order.append((node, linked))
        stack += [(c, linked) for c in node.children if type(c) is Node and not c.gone]
    commas: dict[int, int] = {}
    inline: dict[int, tuple[int, int]] = {}  # characters and commas of a block's own text
    for node, linked in reversed(order):
        size = count = 0
        for c in node.children:
            if type(c) is str:
                size += len(c.strip())
                count += c.count(",")
        node.text += size
        node.linked += size if linked else 0
        own = inline.pop(id(node), (0, 0))
        own = (own[0] + (0 if linked else size), own[1] + (0 if linked else count))
        up = node.parent
        if up is not None:
            up.text += node.text
            up.linked += node.linked
        if node.tag in _BLOCKS or node.tag in ("td", "#page"):
            commas[id(node)] = own[1]
            if own[0] >= 25 and up is not None and node.tag not in _HEADINGS:
                points = 1 + own[1] + min(own[0] / 100, 3)
                share, level = 1.0, 1
                if node.tag not in ("p", "pre", "li"):  # text of its own
                    node.points += points
                while up is not None and level <= 5:
                    up.points += points * share
                    level += 1
                    share = 1 / 2 if level == 2 else 1 / (3 * (level - 1))
                    up = up.parent
        elif up is not None:
            before = inline.get(id(up), (0, 0))
            inline[id(up)] = (before[0] + own[0], before[1] + own[1])
    found = []
    for node, _ in order:
        if node.points:
            node.points *= 1 - node.linked / max(1, node.text)
            node.points += 25 * _own(node) - 25 * bool(node.words & _LEFT_WORDS)
            found.append(node)
    for node, _ in order:  # a name that is partly such a word, and hardly any text but links
        node.gone |= bool(node.words & _LEFT_WORDS) and not node.holds and 2 * node.linked > node.text and node.tag not in ("html", "body")
    return found


def _clear(root: Node) -> None:
    for node in (root, *_elements(root)):
        node.points, node.text, node.linked = 0.0, 0, 0


def _container(root: Node) -> list[Node]:
    """The best container and those neighbours that belong to it, in page order."""
    found = _score(root)
    if not found:
        return [root]
    best = max(found, key=lambda n: n.points)
    up, top = best, best
    while up is not None:
        if _own(up):
            if 4 * (best.text - best.linked) >= up.text - up.linked:
                top = up
            break
        up = up.parent
    if top.parent is None or top.tag in ("body", "html"):
        return [top]
    least, out = max(10.0, 0.2 * top.points), []
    for c in top.parent.children:
        if type(c) is not Node or c.gone:
            continue
        loose = c.tag == "p" and c.text > 80 and c.linked < 0.25 * c.text
        title = c.tag in _HEADINGS and not _own(top)
        if c is top or c.points >= least and c.linked < 0.5 * c.text or loose and not _own(top) or title:
            out.append(c)
    return out


def blocks(nodes: list[Node]) -> Iterator[str]:
    """The text blocks of some elements, in order, white space joined."""
    held: list[str] = []

    def end() -> list[str]:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        return [text] if text else []

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        node = stack.pop()
        if node is None:
            yield from end()
        elif type(node) is str:
            held.append(node)
        elif not node.gone:
            if node.tag in _BLOCKS:
                yield from end()
                stack.append(None)
            elif node.tag in _SPACED:
                held.append(" ")
            stack += reversed(node.children)
    yield from end()


def main_text(html: str | None) -> str:
    if not html or html.isspace():
        return ""
    root = parse(html)
    named = _leave_out(root)
    text = "\n\n".join(blocks(_container(root)))
    if text or not named:
        return text
    for node in named:  # nothing else on the page
        node.gone = False
    _clear(root)
    return "\n\n".join(blocks(_container(root)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py()) for x in b["html"]]
            yield pa.RecordBatch.from_arrays(
                [b["page_id"], b["url"], pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
