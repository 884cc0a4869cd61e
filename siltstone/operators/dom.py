"""A small tree of an HTML page and selectors over it, on the standard parser."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())  # fixed values
_BLOCK = frozenset("article aside blockquote br div footer h1 h2 h3 h4 h5 h6 header li main nav ol p section table td tr ul".split())
_HIDDEN = frozenset(("script", "style", "noscript", "template"))


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def __iter__(self) -> Iterator[Node]:
        """This element and all below it in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, selector: str | Callable[[Node], bool]) -> list[Node]:
        test = matcher(selector) if isinstance(selector, str) else selector
        return [n for n in self if n is not self and test(n)]

    def first(self, *selectors: str) -> Node | None:
        """The first element of the first selector that has one."""
        return next((found for s in selectors for found in self.all(s)[:1]), None)

    def up(self, selector: str) -> Node | None:
        test, node = matcher(selector), self.parent
        while node is not None and not test(node):
            node = node.parent
        return node

    def text(self, blocks: bool = False) -> str:
        parts: list[str] = []

        def walk(node: Node) -> None:
            for c in node.children:
                if isinstance(c, str):
                    parts.append(c)
                elif c.tag not in _HIDDEN:
                    edge = "\n" if c.tag in _BLOCK else ""
                    parts.append(edge)
                    walk(c)
                    parts.append(edge)

        walk(self)
        lines = [" ".join(x.replace("​", " ").split()) for x in "".join(parts).split("\n")]
        return ("\n" if blocks else " ").join(x for x in lines if x)


def matcher(selector: str) -> Callable[[Node], bool]:
    """tag, .class, tag.class and [attr=value] selectors, alternatives after a comma."""
    tests = []
    for one in selector.split(","):
        m = re.fullmatch(r"\s*([a-z0-9]*)((?:\.[\w-]+)*)(?:\[([\w-]+)=([^\]]*)\])?\s*", one)
        if m is None:
            raise ValueError(f"selector {one!r}")
        tests.append((m[1], frozenset(filter(None, m[2].split("."))), m[3], m[4]))
    return lambda n: any((not tag or n.tag == tag) and classes <= set(n.attrs.get("class", "").split()) and (attr is None or n.attrs.get(attr, "").lower() == value.lower()) for tag, classes, attr, value in tests)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#page", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self.at.tag == tag:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root
