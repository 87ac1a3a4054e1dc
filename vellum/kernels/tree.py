"""A small tree of HTML or XHTML elements, built leniently."""

from __future__ import annotations

import sys
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr mbp:pagebreak".split())
RAW = frozenset({"script", "style"})
#: Elements that end an open one of the same group.
SIBLINGS = {"li": {"li"}, "p": {"p"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Element | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Element | str] = []

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def walk(self):
        """All elements below, in document order, however deep."""
        todo = self.elements()[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo += node.elements()[::-1]

    def text(self) -> str:
        out, todo = [], self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                todo += c.children[::-1]
        return "".join(out)

    def find(self, *tags: str) -> Element | None:
        return next((e for e in self.walk() if e.tag in tags), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root")
        self.top = self.root

    def handle_starttag(self, tag, attrs):
        if self.top.tag in SIBLINGS.get(tag, ()):
            self.top = self.top.parent
        node = Element(tag, {k: v or "" for k, v in attrs}, self.top)
        self.top.children.append(node)
        if tag not in VOID:
            self.top = node

    def handle_startendtag(self, tag, attrs):
        self.top.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.top))

    def handle_endtag(self, tag):
        node = self.top
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.top = node.parent

    def handle_data(self, data):
        self.top.children.append(data)


def parse(markup: str) -> Element:
    """Root of a page; end tags that match nothing are ignored, open elements end with the page.

    Pages may nest as deep as they are long, and walks over them call themselves at each level.
    """
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 12 * markup.count("<") + 10_000))
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root
