"""Leaf blocks of HTML pages with their ancestors.

A small tokenizer splits a page into tags and text; a stack of open elements
follows them.  A block is the text between two boundaries of block-level
elements, with white space made single spaces; ``<br>`` counts as white space.
Text inside ``HIDDEN`` elements is no text of the page; one that is not closed
ends with the element around it, and a drawing ends at a tag that HTML does not
allow in it.

The places of open elements are kept by tag, so a tag costs the same however
deep it stands, and a block keeps no list of its ancestors: only its own tag
and which of ``NOTED`` tags and of the wanted words are open around it.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

#: Fixed lists of HTML element names.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("noscript template svg object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key closes an open one of these.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
#: Opening tags that end a drawing, and its elements that may hold HTML.
_LEAVES_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var".split()
) | {"article", "aside", "footer", "header", "main", "nav", "section"}
_HOLDS_HTML = frozenset("foreignobject desc title".split())
_LISTS = tuple("ul ol dl table select body div article".split())
_BOUNDS = {name: tuple(x for x in _LISTS if x != name) for name in _LISTS}
_NO_MARKUP = (*HIDDEN, *_HOLDS_HTML)
#: Ancestors that a block tells of.
NOTED = frozenset("article main nav aside header footer form figure head title li".split())

_TOKEN = re.compile(
    r"<!-->|<!--->|<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|textarea|iframe)(?P<open>(?=[\s/>])[^>]*>).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<shut>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<shut2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    own: str  #: tag of the innermost open element
    within: frozenset[str]  #: open elements among ``NOTED``
    names: frozenset[str]  #: wanted words of the open elements' classes, ids and roles
    linked: int  #: characters inside links


class _Stack:
    """Open elements, with their places by tag."""

    def __init__(self, wanted: frozenset[str]):
        self._wanted = wanted
        self._tags: list[str] = []
        self._names: list[tuple[str, ...]] = []
        self._places: dict[str, list[int]] = defaultdict(list)
        self._open_names: Counter[str] = Counter()
        self.hidden = 0

    def place(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost open element with one of the tags (none: -1)."""
        return max([at[-1] for t in tags if (at := self._places.get(t))], default=-1)

    def above(self, place: int) -> list[str]:
        """Tags from a place on."""
        return self._tags[place:]

    def push(self, tag: str, attributes: str) -> None:
        found = _NAMES.findall(attributes) if "=" in attributes else ()
        names = tuple({w for groups in found for w in _WORD.findall("".join(groups).lower())} & self._wanted) if found else ()
        self._open_names.update(names)
        self._places[tag].append(len(self._tags))
        self._tags.append(tag)
        self._names.append(names)
        self.hidden += tag in HIDDEN

    def cut(self, place: int) -> None:
        """Close the elements from a place on."""
        for tag, names in zip(self._tags[place:], self._names[place:], strict=True):
            self._places[tag].pop()
            self.hidden -= tag in HIDDEN
            self._open_names.subtract(names)
        del self._tags[place:], self._names[place:]

    def block(self, text: str, linked: int) -> Block:
        own = self._tags[-1] if self._tags else ""
        return Block(text, own, frozenset(t for t in NOTED if self._places.get(t)), frozenset(n for n, k in self._open_names.items() if k > 0), linked)


def blocks(page: str | None, wanted: frozenset[str] = frozenset()) -> list[Block]:
    """The non-empty leaf blocks of a page in order (null: none).

    ``wanted`` are the words of classes, ids and roles that blocks shall tell of.
    """
    if not page:
        return []
    stack = _Stack(wanted)
    out: list[Block] = []
    pieces: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(stack.block(text, linked))
            pieces.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not stack.hidden:
            raw = html.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if stack.place(("a",)) >= 0:
                linked += len(raw)

    def drawing() -> int:
        """Place of the open drawing that a tag stands in (none: -1)."""
        k = stack.place(_NO_MARKUP)
        return k if k >= 0 and k == stack.place(("svg",)) else -1

    while m := _TOKEN.search(page, at):
        text(page[at: m.start()])
        at = m.end()
        if m["raw"] and stack.hidden and m["open"].endswith("/>") and drawing() >= 0:
            at = m.end("open")
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["shut"] or m["shut2"]:
            if (k := stack.place((name,))) >= 0:
                gone = stack.above(k)
                inside = stack.hidden > sum(t in HIDDEN for t in gone)
                if not inside and name not in HIDDEN and any(t in BLOCK for t in gone):
                    flush()
                stack.cut(k)
            continue
        if stack.hidden and name in _LEAVES_SVG and (k := drawing()) >= 0:
            stack.cut(k)
        rest = m["rest"] or ""
        if not stack.hidden:
            if name == "br":
                pieces.append(" ")
                continue
            if name in BLOCK:
                flush()
                # A paragraph closes, and an item of the same kind, unless a container in between holds it.
                while (k := stack.place(("p", *CLOSES.get(name, ())))) >= max(0, stack.place(_BOUNDS.get(name, _LISTS))):
                    paragraph = stack.place(("p",)) == k
                    stack.cut(k)
                    if not paragraph:
                        break
        if name not in VOID and not rest.endswith("/"):
            stack.push(name, "" if stack.hidden else rest)
    text(page[at:])
    flush()
    return out
