"""Leaf blocks of an HTML page, in page order, for the extraction model."""

from __future__ import annotations

import re
from collections import namedtuple
from html import unescape

from parasol.llm.common import ship_by_value

ship_by_value(__name__)

Block = namedtuple("Block", "text tag around linked title gold")  # around: the innermost Element, or None


class Element:
    """An open element: the features it adds to its ancestors', a number for its path of names, its gold label."""

    __slots__ = ("parent", "name", "fresh", "path", "gold")

    def __init__(self, parent, name, fresh, path, gold):
        self.parent, self.name, self.fresh, self.path, self.gold = parent, name, fresh, path, gold


def around(block: Block):
    """The features of a block's elements, each once."""
    element = block.around
    while element is not None:
        yield from element.fresh
        element = element.parent


# Element names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split())
RAW_TAGS = frozenset("script style textarea title".split())  # all up to the first end tag is theirs, or the rest of the page
UNSEEN_TAGS = frozenset("head iframe noembed noframes noscript svg template".split()) | RAW_TAGS
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_PARAGRAPH = BLOCK_TAGS - {"body", "button", "html", "option", "select"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
ENDS_SEARCH = {"ul", "ol", "menu", "dl", "table", "select", "body", "article", "section", "div", "nav", "aside", "main"}

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>|[^>]*>?)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|data-gold)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _marks(rest: str) -> tuple[tuple[str, ...], str | None]:
    """The words of an element's class, id and role, and its gold label if it has one."""
    found, gold = [], None
    if "=" in rest or "hidden" in rest:
        for name, *values in ATTRIBUTE.findall(rest):
            value = "".join(values)
            if name == "data-gold":
                gold = value
            elif name.lower() == "hidden":
                found.append("hidden")
            else:
                found += [w.lower() for w in PART.findall(value)]
    return tuple(found), gold


def _ends(page: str, name: str) -> dict[int, int]:
    """Where the end tag of each element of a name ends, by where its start tag begins; elements left open are missing."""
    found, begun = {}, []
    for tag in re.finditer(rf"<(/?){name}(?=[\s/>])[^>]*>?", page, re.I):
        if not tag[1]:
            if not tag[0].endswith("/>"):
                begun.append(tag.start())
        elif begun:
            found[begun.pop()] = tag.end()
    return found


class _Open:
    """The open elements of a page. Each step costs what it adds or takes away, however deep they lie."""

    def __init__(self):
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}  # of the open elements, by name
        self.held: dict[str, int] = {}  # how many open elements carry a feature
        self.paths: dict[tuple[int, str], int] = {}
        self.carried: list[tuple[str, ...]] = []

    def top(self) -> Element | None:
        return self.stack[-1] if self.stack else None

    def push(self, name: str, marks: tuple[str, ...], gold: str | None):
        parent = self.top()
        carried = tuple({"in " + name: None, **{"of " + m: None for m in marks}})
        path = self.paths.setdefault((parent.path if parent else -1, name), len(self.paths))
        fresh = tuple(f for f in carried if not self.held.get(f))
        for f in carried:
            self.held[f] = self.held.get(f, 0) + 1
        self.places.setdefault(name, []).append(len(self.stack))
        self.carried.append(carried)
        self.stack.append(Element(parent, name, fresh, path, gold if gold is not None or parent is None else parent.gold))

    def pop(self, names, until=frozenset()):
        """Closes the innermost element of ``names`` and all within it, unless one of ``until`` lies within it."""
        place, wall = (max((self.places[n][-1] for n in found if self.places.get(n)), default=-1) for found in (names, until))
        if place < 0 or place < wall:
            return
        for element, carried in zip(self.stack[place:], self.carried[place:]):
            self.places[element.name].pop()
            for f in carried:
                self.held[f] -= 1
        del self.stack[place:], self.carried[place:]


def leaf_blocks(html: str | None) -> list[Block]:
    """The blocks that hold text themselves. Runs of white space are one space; character references are decoded.

    A block ends where a block element begins or ends. Elements left open end with the page; an end tag without
    its element is ignored. Of unseen elements only those with an end tag are left out, but for raw text.
    """
    page = html or ""
    blocks: list[Block] = []
    opened = _Open()
    ends: dict[str, dict[int, int]] = {}
    text: list[str] = []
    linked, in_link, title, headed, at = 0, 0, "", False, 0

    def flush():
        nonlocal linked
        if text:
            words = " ".join(unescape("".join(text)).split())
            if words:
                top = opened.top()
                blocks.append(Block(words, top.name if top else "", top, min(1.0, linked / len(words)), title, top.gold if top else None))
            text.clear()
        linked = 0

    token = TOKEN.search(page)
    while token is not None:
        if token.start() > at:
            piece = page[at:token.start()]
            text.append(piece)
            if in_link:
                linked += len(piece)
        at = token.end()
        name = (token["name"] or "").lower()
        if name in UNSEEN_TAGS:
            if token["end"] is None and not token["rest"].endswith("/>"):
                if name in RAW_TAGS:
                    close = re.compile(f"</{name}[^>]*>?", re.I).search(page, at)
                    end = close.end() if close else len(page)
                else:
                    if name not in ends:
                        ends[name] = _ends(page, name)
                    end = ends[name].get(token.start(), at)
                if name == "head" and not headed:
                    headed = True
                    found = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S).search(page, at, end if end > at else len(page))
                    title = " ".join(unescape(found[1]).split()) if found else ""
                at = max(at, end)
        elif name in BLOCK_TAGS:
            flush()
            if token["end"]:
                opened.pop({name})
            else:
                if name in CLOSES_PARAGRAPH:
                    opened.pop({"p"}, ENDS_SEARCH | {"td", "th", "li"})
                if name in CLOSED_BY:
                    opened.pop(CLOSED_BY[name], ENDS_SEARCH)
                if name not in EMPTY_TAGS:
                    opened.push(name, *_marks(token["rest"]))
        elif name == "br":
            text.append(" ")
        elif name == "a":
            in_link = 0 if token["end"] else 1
        token = TOKEN.search(page, at)
    if at < len(page):
        text.append(page[at:])
    flush()
    return blocks
