"""Pages whose lines have their tags: a tree builder with implied tags, visibility rules, and blocks of text.

Lines are read as one text, so that tags and elements can go over line ends.
The builder opens what an element needs around it (``tr`` and ``table`` around
a ``td``, ``ul`` around an ``li``) and closes what a new one ends (a paragraph
before a block, a cell before the next).  Elements that a browser doesn't show,
and those whose tag or role says that they are not the page's content, are
hidden with all that is in them.  What is visible comes out as blocks:
headings, paragraphs, list items with marks and depth, preformatted text, and
rows of cells.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Elements without content, those whose content is no markup, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag ends, and up to which element that reaches.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: What an element needs around it: one of these, else the first is opened.
NEEDS = {"td": ("tr",), "th": ("tr",), "tr": ("table", "thead", "tbody", "tfoot"), "li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",)}
#: Elements that aren't shown, and those that are shown but are no content, by tag and by role.
UNSEEN = frozenset("head script style template noscript noframes iframe object svg canvas audio video textarea datalist".split())
APART = {"nav": "nav", "menu": "nav", "aside": "aside", "footer": "footer", "form": "form", "button": "form", "select": "form", "dialog": "form", "address": "address"}
ROLES = {"navigation": "nav", "menu": "nav", "menubar": "nav", "complementary": "aside", "contentinfo": "footer", "search": "form", "dialog": "form", "alertdialog": "form"}
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(hidden|collapse)", re.IGNORECASE)
_HEADING = re.compile(r"h[1-6]$")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes, and (place in the text, text)


@dataclass
class Block:
    """A piece of visible or hidden text: the element it is, why it is hidden, its text (a row: its cells), and the lines it stands on."""

    tag: str
    hidden: str
    text: str
    cells: list[str]
    lines: list[int]
    mark: str = ""


def tree(text: str) -> Node:
    """The elements of a text of markup."""
    root = Node("html")
    stack = [root]

    def close(which, until) -> None:
        """The innermost of some elements and all in it, if none of ``until`` stands between."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in which:
                del stack[i:]
                return
            if stack[i].tag in until:
                return

    def open_(tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)

    def begin(tag: str, attributes: dict[str, str]) -> None:
        if tag in BLOCK:
            close({"p"}, BLOCK - {"p"})
        if tag in ENDS:
            which, until = ENDS[tag]
            while any(n.tag in which for n in stack[1:]):
                before = len(stack)
                close(which, until)
                if len(stack) == before:
                    break
        if tag in NEEDS and stack[-1].tag not in NEEDS[tag]:
            begin(NEEDS[tag][0], {})
        open_(tag, attributes)

    at = 0
    while at < len(text):
        m = _TOKEN.search(text, at)
        if m is None or m.start() > at:
            stack[-1].children.append((at, text[at : m.start() if m else len(text)]))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if any(n.tag == tag for n in stack[1:]):
                # a cell's end doesn't end a table around it
                close({tag}, {"table"} if tag in ("p", "li", "td", "th", "tr", "div", "span") else set())
            continue
        if tag == "html":
            continue
        begin(tag, {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])})
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(text, at)
            stack[-1].children.append((at, text[at : end.start() if end else len(text)]))
            at = end.end() if end else len(text)
            stack.pop()
    return root


def _why_hidden(node: Node) -> str:
    """The kind of hidden element that a node is, if it is one."""
    a = node.attributes
    if node.tag in UNSEEN or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDING.search(a.get("style", "")):
        return "unseen"
    return ROLES.get(a.get("role", "").lower(), "") or APART.get(node.tag, "")


def blocks(lines: list[tuple[int, str | None]]) -> list[Block]:
    """The blocks of a page's lines, in order."""
    parts, starts, at = [], [], 0
    for _, line in lines:
        starts.append(at)
        parts.append(line or "")
        at += len(parts[-1]) + 1
    numbers = [n for n, _ in lines]
    out: list[Block] = []
    now: list[tuple[int, str]] = []  # text of the open block

    def line_of(place: int) -> int:
        low, high = 0, len(starts)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if starts[middle] <= place else (low, middle)
        return low

    def on(pieces: list[tuple[int, str]]) -> list[int]:
        """Numbers of the lines that text stands on."""
        found = {}
        for place, x in pieces:
            for part in re.finditer(r"[^\n]+", x):
                if part[0].strip():
                    found[line_of(place + part.start())] = None
        return [numbers[i] for i in sorted(found)]

    def text_of(pieces: list[tuple[int, str]], pre: bool = False) -> str:
        whole = html.unescape("".join(x for _, x in pieces))
        return whole.strip("\n").rstrip() if pre else " ".join(whole.split())

    def end(tag: str, why: str, mark: str = "") -> None:
        text = text_of(now, tag == "pre")
        if text.strip():
            out.append(Block(tag, why, text, [], on(now), mark))
        now.clear()

    def inside(node: Node) -> list[tuple[int, str]]:
        return [x for c in node.children for x in ([c] if isinstance(c, tuple) else [] if _why_hidden(c) == "unseen" else inside(c))]

    def walk(node: Node, tag: str, why: str, depth: int, mark: str) -> None:
        nth = 0
        for c in node.children:
            if isinstance(c, tuple):
                now.append(c)
            elif c.tag == "br":
                if tag == "pre":
                    now.append((0, "\n"))
                else:
                    end(tag, why, mark)
            elif c.tag == "tr" and not why and not _why_hidden(c):
                end(tag, why, mark)
                cells = [k for k in c.children if isinstance(k, Node) and k.tag in ("td", "th")]
                if any(isinstance(x, Node) and x.tag == "table" for k in cells for x in k.children):
                    walk(c, tag, why, depth, "")  # a table that lays out the page: its cells are blocks
                    continue
                row, pieces = [], []
                for k in cells:
                    own = [] if _why_hidden(k) else inside(k)
                    pieces += own
                    span = k.attributes.get("colspan", "")
                    row += [text_of(own), *[""] * (min(int(span), 64) - 1 if span.isdigit() and int(span) > 0 else 0)]
                if any(row):
                    out.append(Block("tr", "", " | ".join(row), row, on(pieces)))
            elif c.tag not in BLOCK and not why and _why_hidden(c) == "unseen":  # within a line: it ends no block
                pieces = [x for k in c.children for x in ([k] if isinstance(k, tuple) else inside(k))]
                if text := text_of(pieces):
                    out.append(Block("p", "unseen", text, [], on(pieces)))
            elif c.tag in BLOCK or _why_hidden(c) and not why:
                end(tag, why, mark)
                mark = ""  # only an item's first block has its mark
                kind = "h" if _HEADING.match(c.tag) else c.tag if c.tag in ("li", "pre", "dt", "dd") else tag if tag in ("li", "pre", "h") else "p"
                own = ""
                if c.tag == "li":
                    nth += 1
                    own = "  " * max(0, depth - 1) + (f"{nth}. " if node.tag == "ol" else "- ")
                hidden = why or _why_hidden(c)
                walk(c, kind, hidden, depth + (c.tag in ("ul", "ol", "menu", "dir")), own)
                end(kind, hidden, own if not any(isinstance(x, Node) and x.tag in BLOCK for x in c.children) else "")
            elif not (_why_hidden(c) == "unseen" and why != "unseen"):
                walk(c, tag, why, depth, "")
        return None

    root = tree("\n".join(parts))
    walk(root, "p", "", 0, "")
    end("p", "")
    return out
