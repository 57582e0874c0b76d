"""DOM leaf blocks of raw html, without building a tree.

A leaf block is the text between two block-level boundaries.  Scripts, styles, comments,
titles and other content that is never shown make no blocks; fallback text does.  Rules
of the html standard that matter for raw pages are kept: a block-level start closes an
open paragraph, list items and table cells close their like, stray end tags are ignored,
and a head ends at the first text or start tag that is not head content.

The scan is linear in the page: the attribute pattern never backtracks, markup that
nothing closes is looked for once, and no more than ``DEPTH`` elements are open at a time
(deeper ones become siblings, as in browsers; their text stays).  A tag that is never
closed by ``>`` is text.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

DEPTH = 512
#: never shown; unclosed, these run to the page end
RAW = frozenset("script style textarea title".split())
#: never shown as text if closed; unclosed, they hide nothing
HIDDEN = RAW | frozenset("template svg select".split())
CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in HIDDEN}
HEAD_CONTENT = frozenset("html head base basefont bgsound link meta title script style noscript noframes template".split())
OPENING = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
QUOTED = re.compile(r"""(?>[^'">]+|"[^"]*"|'[^']*')*+>""")
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul label noscript object video audio canvas iframe".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_LIKE = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
LIKE_STOPS = frozenset("ul ol menu dl table".split())
P_STOPS = frozenset(("table", "button"))
NO_CLOSE_P = frozenset("body html head label button noscript object video audio canvas iframe".split())
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACES = re.compile(r"[\x20\x09-\x0D]+")


@dataclass(slots=True, eq=False)
class Element:
    """An open block-level element; ``depth`` counts its ancestors, ``memo`` is for the reader of blocks."""

    tag: str
    names: str
    parent: Element | None
    depth: int
    memo: object = field(default=None)


@dataclass(slots=True)
class Block:
    element: Element | None
    text: str
    link_chars: int

    @property
    def path(self) -> list[tuple[str, str]]:
        """(tag, names) of each open block-level element, outermost first."""
        out, at = [], self.element
        while at is not None:
            out.append((at.tag, at.names))
            at = at.parent
        return out[::-1]


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[Element] = []
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = depth = at = 0
    unclosed: set[str] = set()
    in_head = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", entities.unescape("".join(parts))).strip(" ")
            if text:
                out.append(Block(stack[-1] if stack else None, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def cut(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    def pop(names: tuple[str, ...], stops: frozenset) -> None:
        if any(opened.get(name) for name in names):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in names:
                    cut(k)
                    return
                if stack[k].tag in stops:
                    return

    def end_head() -> None:
        nonlocal in_head
        in_head = False
        pop(("head",), frozenset())

    last = page.rfind(">")
    while m := OPENING.search(page, at):
        if m[0] == "<!--":
            stop = page.find("-->", m.end())
            stop, attrs = len(page) if stop < 0 else stop + 3, ""
        elif m.end() > last + 1 or m.end() > last and m[2]:
            break  # nothing closes this tag or any after it
        elif m[2] and (inside := QUOTED.match(page, m.end())):
            stop, attrs = inside.end(), inside[0][:-1]
        else:
            stop = page.index(">", m.end()) + 1
            attrs = page[m.end() : stop - 1]
        if m.start() > at:
            between = page[at : m.start()]
            if in_head and between.strip():
                end_head()
            parts.append(between)
            if depth:
                linked += m.start() - at
        at, tag, closing = stop, (m[2] or "").lower(), bool(m[1])
        if not tag:
            continue
        if in_head and not closing and tag not in HEAD_CONTENT:
            end_head()
        if tag in HIDDEN and not closing and not attrs.endswith("/") and tag not in unclosed:
            if (end := CLOSE[tag].search(page, at)) and (stop := page.find(">", end.end())) >= 0:
                at = stop + 1
            elif tag in RAW:
                at = len(page)
            else:
                unclosed.add(tag)
            continue
        if tag in VOID and tag != "hr":
            if tag == "br":
                parts.append(" ")
            continue
        if tag == "a":
            depth = 0 if closing else 1
            continue
        if tag not in BLOCK:
            continue
        flush()
        if tag == "head":
            in_head = not closing
        if closing:
            pop((tag,), frozenset())
            continue
        if tag == "hr":
            pop(("p",), frozenset())
            continue
        if tag not in NO_CLOSE_P:
            pop(("p",), P_STOPS)
        if tag in CLOSES_LIKE:
            pop(CLOSES_LIKE[tag], LIKE_STOPS)
        names = " ".join(x for g in NAMES.findall(attrs) for x in g if x).lower() if "=" in attrs else ""
        if len(stack) == DEPTH:
            cut(DEPTH - 1)
        stack.append(Element(tag, names, stack[-1] if stack else None, len(stack)))
        opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        parts.append(page[at:])
        if depth:
            linked += len(page) - at
    flush()
    return out
