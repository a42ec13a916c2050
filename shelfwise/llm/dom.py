"""A small tolerant DOM: tags, attributes that matter, text. Enough for page extraction, in one pass over the html."""

from __future__ import annotations

import html
import re

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split())
#: A start tag on the left ends open elements on the right, up to the nearest listed border.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])), "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())), "option": (frozenset(["option"]), frozenset(["select"])),
}
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul".split())
BORDER_P = frozenset("table td th caption button object template html body div article section main aside header footer nav form li".split())


class Node:
    __slots__ = ("tag", "attributes", "children", "parent", "weight")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.weight = 1.0


def _attributes(source: str) -> dict[str, str]:
    if not source.strip(" /\n\t"):
        return {}
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(double or single or bare))
    return out


def parse(source: str) -> Node:
    """The document's root; text keeps its white space, with character references decoded.

    Comments, declarations and the content of script, style and other raw elements are left out. End tags without an open
    element are ignored; elements still open at the end, or left open by a parent's end, end there.
    """
    root = Node("", {}, None)
    at, position, size = root, 0, len(source)
    match = _PART.match
    while position < size:
        found = match(source, position)
        position = found.end()
        tag = found[2]
        if tag is None:
            text = found[0]
            if text[0] != "<" or text == "<":
                at.children.append(html.unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if found[1]:
            node = at
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                at = node.parent
            continue
        if tag in ENDS_P:
            node = at
            while node is not root and node.tag != "p" and node.tag not in BORDER_P:
                node = node.parent
            if node.tag == "p":
                at = node.parent
        elif tag in CLOSES:
            ends, border = CLOSES[tag]
            node, last = at, None
            while node is not root and node.tag not in border:
                if node.tag in ends:
                    last = node
                node = node.parent
            if last is not None:
                at = last.parent
        node = Node(tag, _attributes(found[3]), at)
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, position)
            position = end.end() if end else size
        elif tag not in VOID and not found[3].rstrip().endswith("/"):
            at = node
    return root
