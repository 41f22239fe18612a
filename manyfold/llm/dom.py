"""A tolerant HTML reader that keeps what main-text extraction needs: block elements, their attributes and their texts.

Inline elements (``b``, ``a``, ``span`` and any other name outside the lists below) are no nodes of their own: their text
belongs to the block element around them, and text inside links is counted there.  Texts inside ``script``, ``style`` and
other elements that show nothing are left out.
"""

from __future__ import annotations

import re
from html import unescape

#: Fixed values of the HTML standard: elements that are laid out as blocks, and elements whose text is never shown.
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video select option textarea button title datalist".split())
#: Of those, the ones whose content is plain characters up to their end tag.
RAW = frozenset("script style title textarea iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag (key) ends these open elements, if they stand between it and the nearest enclosing scope.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody", "thead"), "option": ("option",)}
SCOPES = frozenset("ul ol menu dl table html body div article section main nav".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_TOKENS = re.compile(r"[A-Z]?[a-z]++|[A-Z]++")


class Node:
    """A block element; ``items`` holds its texts and child nodes in page order."""

    __slots__ = ("attributes", "depth", "items", "linked", "parent", "place", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: tuple[str, ...]):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.depth = parent.depth + 1 if parent else 0
        self.items: list[str | Node] = []
        self.linked = 0
        self.place = 0


def attribute_tokens(raw: str) -> tuple[str, ...]:
    """Lower-case words of an opening tag's class, id and role."""
    if "=" not in raw:
        return ()
    found = [m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw) if m[1].lower() in ("class", "id", "role")]
    return tuple(t.lower() for value in found for t in _TOKENS.findall(value))


def parse(html: str) -> list[Node]:
    """The block elements of a page in page order, parents before their children; the first is the page itself."""
    root = Node("html", None, ())
    nodes, node, at, links, hidden, size = [root], root, 0, 0, "", len(html)
    deep = 0  # of open elements called `hidden`
    while at < size:
        start = html.find("<", at)
        if start < 0:
            start = size
        m = _MARKUP.match(html, start) if start < size else None
        while start < size and m is None:  # a lone < is text
            start = html.find("<", start + 1)
            if start < 0:
                start = size
            else:
                m = _MARKUP.match(html, start)
        if start > at and not hidden:
            text = html[at:start]
            if "&" in text:
                text = unescape(text)
            node.items.append(text)
            if links:
                node.linked += len(text.strip())
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            end = re.compile(f"</{tag}[^>]*+>?", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if hidden == "head" and not closing and tag in BLOCKS:
            hidden, deep = "", 0  # a head without an end
        if hidden:
            if tag == hidden:
                deep += -1 if closing else 1
                if deep == 0:
                    hidden = ""
            continue
        if tag in HIDDEN:
            if not closing and not m[3].endswith("/"):
                hidden, deep = tag, 1
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1)) if closing or not links else links
            continue
        if tag == "br":
            node.items.append(" ")
            continue
        if tag not in BLOCKS or tag == "html":
            continue
        if closing:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node, links = up.parent, 0
            continue
        links = 0
        if node.tag == "p" or tag[0] == "h" and tag[1:].isdigit() and node.tag[0] == "h" and node.tag[1:].isdigit():
            node = node.parent  # a block ends an open paragraph; a heading an open heading
        ends, up = ENDS.get(tag), node
        while ends and up.tag not in SCOPES:
            if up.tag in ends:
                node = up.parent
            up = up.parent
        if tag == "body" and node is root and len(nodes) > 1 and nodes[1].tag == "body":
            continue
        new = Node(tag, node, attribute_tokens(m[3]))
        node.items.append(new)
        nodes.append(new)
        if tag not in VOID:
            node = new
    return nodes


def blocks_of(nodes: list[Node], kept: list[bool]) -> list[str]:
    """Texts of the kept nodes' blocks in page order, white space reduced; a child element ends its parent's block.

    A text without kept blocks gives none.  Works without recursion, as pages may be nested very deeply.
    """
    for i, n in enumerate(nodes):
        n.place = i
    out: list[str] = []
    run: list[str] = []
    stack = [(nodes[0], iter(nodes[0].items))]
    while stack:
        node, items = stack[-1]
        for item in items:
            if isinstance(item, str):
                if kept[node.place]:
                    run.append(item)
            else:
                break
        else:
            item = None
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()
        if item is None:
            stack.pop()
        else:
            stack.append((item, iter(item.items)))
    return out
