"""A small HTML tree: elements, text, selectors, nearest ancestors. Standard library only; runs inside UDFs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from itertools import islice

from .. import fixed

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title"))
_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# an opening tag closes these open ones, up to the scope's container
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "a": ({"a"}, {"td", "th", "table", "object"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
        "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def elements(self) -> Iterator[Node]:
        """Descendants in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(out)

    def ancestors(self) -> Iterator[Node]:
        """Itself and its ancestors, nearest first."""
        node: Node | None = self
        while node is not None and node.name != "#document":
            yield node
            node = node.parent


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            for node in self.open:
                if node.name == tag:
                    for k, v in own.items():
                        node.attrs.setdefault(k, v)
                    return
        if tag in _BLOCKS:
            self._close({"p"}, {"button", "td", "th", "table", "object"})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        node = Node(tag, own, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def _close(self, names: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in names:
                # the outermost one before the container
                while i > 1 and self.open[i - 1].name in names:
                    i -= 1
                del self.open[i:]
                return
            if self.open[i].name in stop:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


# selectors: comma lists of compounds (tag, .class, #id, [a], [a=v], [a*=v], :not(...)) joined by descendants and ">"
_PIECE = re.compile(r"""([a-zA-Z][\w-]*|\*)|\.([\w-]+)|\#([\w-]+)|\[([\w-]+)(?:([*^$~|]?=)["']?([^"'\]]*)["']?)?\]|:not\(([^)]*)\)""")


@lru_cache(maxsize=4096)
def _compiled(selector: str) -> tuple:
    out = []
    for one in re.split(r",(?![^\[]*\])", selector):
        parts = re.findall(r">|(?:\[[^\]]*\]|:not\([^)]*\)|[^\s>\[:]|:(?!not\())+", one.strip())
        steps, child = [], False
        for part in parts:
            if part == ">":
                child = True
            else:
                steps.append((child, tuple(_PIECE.findall(part))))
                child = False
        out.append(tuple(steps))
    return tuple(out)


def _fits(node: Node, compound: tuple) -> bool:
    for tag, cls, id_, attr, op, value, negated in compound:
        if tag and tag != "*" and node.name != tag.lower() or cls and cls not in (node.get("class") or "").split() or id_ and node.get("id") != id_:
            return False
        if attr:
            have = node.get(attr)
            if have is None:
                return False
            if op and not {"=": have == value, "*=": bool(value) and value in have, "^=": bool(value) and have.startswith(value),
                "$=": bool(value) and have.endswith(value), "~=": value in have.split(), "|=": have == value or have.startswith(value + "-")}[op]:
                return False
        if negated and matches(node, negated):
            return False
    return True


def _chain(node: Node, steps: tuple) -> bool:
    child, compound = steps[-1]
    if not _fits(node, compound):
        return False
    if len(steps) == 1:
        return True
    above = node.parent
    while above is not None and above.name != "#document":
        if _chain(above, steps[:-1]):
            return True
        if child:
            return False
        above = above.parent
    return False


def matches(node: Node, selector: str) -> bool:
    return any(_chain(node, steps) for steps in _compiled(selector) if steps)


def closest(node: Node, selector: str) -> Node | None:
    return next((n for n in node.ancestors() if matches(n, selector)), None)


#: Ancestors looked at, the element itself included.
DEPTH = 200


class Selectors:
    """Selectors in order, filed by what the element they end at must have, so that a node is tested against few of them."""

    def __init__(self, selectors: list[str]):
        self.filed: dict[str, list[tuple[int, str, tuple]]] = {}
        for number, selector in enumerate(selectors):
            for steps in filter(None, _compiled(selector)):
                self.filed.setdefault(self._handle(steps[-1][1]), []).append((number, selector, steps))

    @staticmethod
    def _handle(compound: tuple) -> str:
        for tag, cls, id_, attr, *_ in compound:
            if id_ or cls or attr:
                return f"#{id_}" if id_ else f".{cls}" if cls else f"[{attr}"
        return next((tag.lower() for tag, *_ in compound if tag and tag != "*"), "*")

    def first(self, node: Node) -> str | None:
        """The first selector in the list that the node matches."""
        handles = [node.name, "*", *(f"[{a}" for a in node.attrs), *(f".{c}" for c in (node.get("class") or "").split())]
        if node.get("id"):
            handles.append(f"#{node.get('id')}")
        hits = [(n, selector) for h in handles for n, selector, steps in self.filed.get(h, ()) if _chain(node, steps)]
        return min(hits)[1] if hits else None

    def nearest(self, node: Node) -> tuple[int, str] | None:
        """How far up the nearest match is, and what it matches."""
        return next(((up, hit) for up, n in enumerate(islice(node.ancestors(), DEPTH)) if (hit := self.first(n))), None)


class Regions:
    """Site chrome and main content by the nearest ancestors."""

    def __init__(self, chrome: list[str], main: list[str]):
        self.chrome, self.main = Selectors(chrome), Selectors(main)
        self.strong = {s for s in chrome if re.search(fixed.STRONG_CHROME, s, re.I)}

    def of(self, node: Node) -> str:
        """Chrome counts if there is no main content around, or, for strong chrome, if it is the nearer one of the two."""
        chrome = self.chrome.nearest(node)
        if chrome is None:
            return "main_content"
        main = self.main.nearest(node)
        outside = main is None or (chrome[0] < main[0] and chrome[1] in self.strong)
        return "site_chrome" if outside else "main_content"


@lru_cache(maxsize=64)
def _regions(chrome: tuple[str, ...], main: tuple[str, ...]) -> Regions:
    return Regions(list(chrome), list(main))


def placement(node: Node, chrome: list[str], main: list[str]) -> str:
    """main_content or site_chrome; navigation inside main content is content."""
    return _regions(tuple(chrome), tuple(main)).of(node)


def _step(node: Node) -> str:
    if node.get("id"):
        return f"{node.name}#{node.get('id')}"
    classes = (node.get("class") or "").split()[:2]
    siblings = [c for c in (node.parent.children if node.parent else ()) if isinstance(c, Node) and c.name == node.name]
    number = f":nth-of-type({siblings.index(node) + 1})" if len(siblings) > 1 else ""
    return ".".join([node.name, *classes]) + number


def css_path(node: Node, most: int = 4) -> str:
    """The way down to the element from the nearest ancestor with an id, or from a few levels up."""
    line = list(islice(node.ancestors(), most))
    anchor = next((i for i, n in enumerate(line) if n.get("id")), len(line) - 1)
    return " > ".join(_step(n) for n in reversed(line[: anchor + 1]))
