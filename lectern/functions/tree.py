"""Markup as a tree: built with the end tags that HTML leaves out, changed in place, and written again."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that no paragraph can hold: one that starts ends an open paragraph.
BLOCKS = frozenset("address article aside blockquote body details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td th thead tr ul".split())
#: Elements that stand in one another; what lies deeper follows its parent instead of standing in it.
DEEPEST = 150


class Node:
    """An element with attributes and children, which are nodes and strings."""

    __slots__ = ("attrs", "kids", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, kids: list | None = None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs or {}, None, []
        for kid in kids or ():
            self.add(kid)

    def add(self, kid: Node | str) -> None:
        if isinstance(kid, Node):
            kid.up = self
        self.kids.append(kid)

    def walk(self) -> Iterator[Node]:
        """The elements below, in the order of the text; what is put in place of one is not visited."""
        due = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while due:
            yield (kid := due.pop())
            if kid.kids and kid.up is not None:
                due += [k for k in reversed(kid.kids) if isinstance(k, Node)]

    def find(self, *tags: str) -> list[Node]:
        found, due = [], [k for k in reversed(self.kids) if isinstance(k, Node)]
        while due:
            kid = due.pop()
            if kid.tag in tags:
                found.append(kid)
            if kid.kids:
                due += [k for k in reversed(kid.kids) if isinstance(k, Node)]
        return found

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def above(self) -> Iterator[Node]:
        node = self.up
        while node is not None:
            yield node
            node = node.up

    def closest(self, fits: Callable[[Node], bool]) -> Node | None:
        return next(filter(fits, self.above()), None)

    def replace(self, *new: Node | str) -> None:
        """Puts nodes and strings where this one stands; it is in the tree no more."""
        up = self.up
        at = next(i for i, k in enumerate(up.kids) if k is self)
        up.kids[at : at + 1] = new
        self.up = None
        for kid in new:
            if isinstance(kid, Node):
                kid.up = up

    def unwrap(self) -> None:
        kids, self.kids = self.kids, []
        self.replace(*kids)

    def clear(self, *new: Node | str) -> None:
        """Puts ``new`` in place of all children; these are in the tree no more."""
        for node in list(self.walk()):
            node.up = None
        self.kids = []
        for kid in new:
            self.add(kid)

    def wrap_kids(self, tag: str) -> None:
        kids, self.kids = self.kids, []
        self.add(Node(tag, {}, kids))

    def next_element(self) -> Node | None:
        after = self.up.kids[next(i for i, k in enumerate(self.up.kids) if k is self) + 1 :]
        return next((k for k in after if isinstance(k, Node)), None)

    def written(self, keep: Callable[[Node], dict[str, str] | None]) -> str:
        """Children as markup. ``keep`` gives an element's attributes, or None for one whose children alone are written."""
        out = []
        for kid in self.kids:
            if isinstance(kid, str):
                out.append(html.escape(kid, quote=False))
            elif (told := keep(kid)) is None:
                out.append(kid.written(keep))
            else:
                start = f"<{kid.tag}" + "".join(f' {k}="{html.escape(v)}"' for k, v in told.items()) + ">"
                out.append(start if kid.tag in VOID else f"{start}{kid.written(keep)}</{kid.tag}>")
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs, tag not in VOID)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs, False)
        self.cdata_elem = None

    def _start(self, tag: str, attrs: list, opens: bool) -> None:
        if tag in BLOCKS:
            self._end("p", until=tuple(BLOCKS - {"p"}))
        if tag == "li":
            self._end("li", until=("ol", "ul"))
        elif tag == "a":
            self._end("a", until=tuple(BLOCKS))
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.at.add(node)
        if opens and self.depth < DEEPEST:
            self.at = node
            self.depth += 1

    def handle_endtag(self, tag):
        # an inline element doesn't end the blocks that stand open in it
        self._end(tag, until=() if tag in BLOCKS else tuple(BLOCKS))

    def handle_data(self, data):
        self.at.add(data)

    def _end(self, tag: str, until: tuple[str, ...]) -> None:
        node, left = self.at, self.depth
        while node.up is not None and node.tag != tag and node.tag not in until:
            node, left = node.up, left - 1
        if node.up is not None and node.tag == tag:
            self.at, self.depth = node.up, left - 1


def parsed(markup: str | None) -> Node:
    builder = _Builder()
    builder.feed(markup or "")
    builder.close()
    return builder.root
