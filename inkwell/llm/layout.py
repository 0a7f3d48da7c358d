"""The main text of a page: its lines laid out as a tree, furniture hidden, the rest rendered.

Where lines have their tags, ``markup`` builds the tree from these.  Where the
tags are gone, as in this crawl, the tree builder gives every line the element
it implies — ``nav``, ``aside``, ``footer``, ``form``, ``address``
or, for the article, ``h1``, ``h2``, ``p``, ``li``, ``tr``, ``pre`` — and opens
and closes the parents that such an element needs (``li`` a ``ul``, ``tr`` a
``table``, an item after a box's heading that box's ``aside``).  Visibility
rules hide elements that are not the article; the renderer emits the others'
text with block spacing, list marks and aligned table cells.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from inkwell.llm import lexicon, markup
from inkwell.llm.encoding import hypotheses

#: Roles of a line that are not the article, and the element each implies.
HIDDEN = {"nav": "nav", "crumb": "nav", "consent": "form", "byline": "address", "share": "form", "prompt": "form", "ad": "aside",
          "legal": "footer", "box": "aside", "item": "aside", "teaser": "aside", "aside": "aside"}
MENU_SHARE = 0.4  # entries of a bar that must be menu words

_COUNT = re.compile(r" \(\d+\)$")
_BAR = re.compile(r" ?[·•|/»›>] ?| [-–] |\s{2,}|\t")
_LAST = re.compile(r"[.!?…。！？][\"'”“’»)\]]*$")
_NUMBERED = re.compile(r"^\d{1,2}\. ")
_TEASER = re.compile(r"^(>>|»|→|►|▶) ")
_ROW = re.compile(r"\S ?\| ?\S|\t")
_LIST = re.compile(r"^([-*•‣–—] |\d+[.)] |\d+ ?(g|kg|ml|l|cl|dl)\b)")
#: What tells that lines have their tags.
MARKUP = r"(?i)</?(html|head|body|title|div|span|p|br|ul|ol|li|dl|dt|dd|table|thead|tbody|tfoot|tr|td|th|caption|h[1-6]|nav|aside|header|footer|main|section|article|form|button|select|option|script|style|noscript|template|pre|blockquote|figure|figcaption|address|a|b|i|em|strong|img)(\s[^<>]*)?/?>"
_MARKUP = re.compile(MARKUP)
_COOKIES, _WITH_COOKIES = re.compile(lexicon.COOKIES), re.compile(lexicon.WITH_COOKIES)
_TREE = re.compile(r"^[│├└─┌ ]{2,}")
_URL = re.compile(r"https?://|www\.")
#: Single-byte mix-ups that furniture is looked for under, and characters that such lines show.
_SINGLE = ["cp1252>cp437", "cp1252>mac_roman", "cp1252>cp850", "cp1251>cp1252", "koi8_r>cp1251", "cp1250>cp1252", "iso8859_2>cp1252"]
_STRANGE = re.compile("[Α-ω⌠⌡ⁿ∩≈≤≥²│┤╡-╬╧-╫╪█▄▌▐▀¸‚‰˙ÈÌÛÙ¿³¶±¹][a-zé]|[a-z][Α-ω⌠⌡ⁿ∩╡-╫¸‚‰˙ÈÌÛÙ¿³¶±¹]|[À-ÿ]{3}|[а-я][А-Я]|^[╘⌐└©╔]")
_ODD = re.compile("[\u0080-\u009f¡-ª¬-¶¸-º¼-¿ÂÃÄÅÐÑâĂĹ├┬╬╨╤ÔÇ√‚][^\x00-\x7f\\s]|[РС][^\x00-\x7fА-яЁё\\s]")


@lru_cache(1)
def _cues():
    shapes = "|".join(f"(?P<{kind}>{'|'.join(p)})" for kind, p in lexicon.SHAPES.items())
    entries = lexicon.menu_entries()
    return (lexicon.whole_lines(), lexicon.beginnings(), lexicon.parts(), re.compile(shapes), re.compile("|".join([f"(?P<byline>{lexicon.NOTES})", *(f"(?P<{k}>{'|'.join(p)})" for k, p in lexicon.RUNS_ON.items())])),
            entries, frozenset(w for x in entries for w in x.split()))


def _ends(line: str) -> bool:
    """Whether a line ends as a sentence does."""
    return _LAST.search(line[-4:]) is not None


def _taken_back(text: str) -> str:
    """Text that was UTF-8 and read in another encoding throughout, maybe twice, as it was."""
    for _ in range(2):
        if text.isascii() or not _ODD.search(text):
            break
        before = next((b for t in hypotheses().values() if t.wide and t.times == 1 and (b := t.undo(text))), None)
        if before is None:
            break
        text = before
    return text


def flat(text: str | None) -> str:
    """A line with single spaces, wrong encodings taken back."""
    return " ".join(_taken_back(text or "").split())


def _menu_bar(raw: str, line: str, entries: frozenset[str], words: frozenset[str]) -> bool:
    parts = [p.strip() for p in _BAR.split(raw.strip()) if p.strip()]
    if len(parts) > 2 and max(map(len, parts)) < 30:
        known = sum(p.lower() in entries for p in parts)
        if known >= MENU_SHARE * len(parts) and known > 1:
            return True
    split = line.lower().split(" ")
    return len(split) > 3 and not _ends(line) and sum(w in words for w in split) >= 0.7 * len(split)


_known: dict[str, tuple[str | None, str]] = {}


def role(raw: str | None) -> tuple[str | None, str]:
    """What a line is by itself — a key of HIDDEN, ``blank``, or None for text that may be the article — and the flat line."""
    raw = raw or ""
    got = _known.get(raw)
    if got is None:
        text = _taken_back(raw)
        line = " ".join(text.split())
        kind = _role(text, line)
        if kind is None and not line.isascii():
            kind = _by_skeleton(line) or (_strange_role(line) if _STRANGE.search(line) else None)
        got = (kind, line)
        if len(raw) < 80 and len(_known) < 200_000:
            _known[raw] = got
    return got


_OUTSIDE = re.compile("[^\x00-\x7f]+")


def _skeleton(line: str) -> str:
    """What is left of a line without characters outside ASCII, which is all that lost or strange characters leave as it was."""
    return " ".join(_OUTSIDE.sub("", line.lower()).split())


def _by_skeleton(line: str) -> str | None:
    """The role of a line that is, or begins with, a phrase of furniture but for its characters outside ASCII."""
    known, begins, most = _skeletons()
    if line.count(" ") > most:  # no phrase has more words, and lost characters don't add any
        return None
    left = _skeleton(line)
    return known.get(left) or next((kind for x, kind in begins if left.startswith(x)), None)


@lru_cache(1)
def _skeletons() -> tuple[dict[str, str], list[tuple[str, str]], int]:
    """Kinds of whole lines and beginnings that hold such characters, by what they have besides (short ones could be anything), and the most spaces."""
    whole = {**dict.fromkeys(lexicon.menu_entries(), "nav"), **lexicon.whole_lines()}
    known = {x: kind for x, kind in whole.items() if not x.isascii() and len(_skeleton(x)) > 5}
    begins = [(k, kind) for starts, kind in lexicon.beginnings() for x in starts if not x.isascii() and len(k := _skeleton(x)) > 8]
    return {_skeleton(x): kind for x, kind in known.items()}, begins, max(x.count(" ") for x in known)


def _strange_role(line: str) -> str | None:
    """The role of a line of furniture that was read in a wrong single-byte encoding."""
    for name in _SINGLE:
        before = hypotheses()[name].undo(line)
        if before and before != line and (kind := _role(before, before)) not in (None, "teaser"):
            return kind
    return None


def _role(raw: str, line: str) -> str | None:
    if not line:
        return "blank"
    whole, begins, holds, shapes, notes, entries, words = _cues()
    low = line.lower()
    for starts, kind in begins:
        if low.startswith(starts):
            return kind
    for part, kind in holds:
        if part in low:
            return kind
    if ("cookie" in low or "куки" in low) and low.count(" ") < lexicon.COOKIE_WORDS and _COOKIES.search(low) and _WITH_COOKIES.search(low):
        return "consent"
    m = notes.match(low)
    if m:
        return next(k for k, v in m.groupdict().items() if v is not None)
    bare = _COUNT.sub("", low)
    if bare in entries:
        return "nav"
    if kind := whole.get(bare):
        return kind
    if _ends(line):
        return None
    if m := shapes.fullmatch(bare):
        return next(k for k, v in m.groupdict().items() if v is not None)
    head, sign, rest = low.partition(" > ")
    if sign and (head in entries or any(e.startswith(head + " ") for e in entries)) and len(rest.split()) < 5:
        return "crumb"
    if _menu_bar(raw, line, entries, words):
        return "nav"
    if _TEASER.match(line) and not _URL.search(line):
        return "teaser"
    return None


def is_title(line: str) -> bool:
    """A line that could be a headline: some words, no end of a sentence, no row, item or address."""
    return (len(line) < 140 and 1 < line.count(" ") < 19 and not _ends(line) and not ("|" in line and _ROW.search(line))
            and not _LIST.match(line) and not _TREE.match(line) and not _URL.search(line))


def is_markup(lines: list[tuple[int, str | None]]) -> bool:
    """Whether a page's lines have their tags."""
    return any(x and "<" in x and _MARKUP.search(x) for _, x in lines)


def roles(lines: list[str | None]) -> tuple[list[str | None], list[str]]:
    """The role of every line of a page, in order, with its neighbours taken into account, and the flat lines."""
    known = [role(x) for x in lines]
    found, texts = [r for r, _ in known], [t for _, t in known]
    real = [i for i, r in enumerate(found) if r != "blank"]
    kinds, own = [found[i] for i in real], [texts[i] for i in real]
    walked, end = walk(kinds, own, real, START, (False, False), breadcrumb(kinds, own))
    for i, kind in zip(real, walked, strict=True):
        found[i] = kind
    shown = last_shown(end)
    if shown is not None:
        found[shown] = None
    return found, texts


def breadcrumb(kinds: list[str | None], texts: list[str]) -> str:
    """What the page's first breadcrumb names last, in lower case; it can be cut short."""
    return next((t.rsplit("›", 1)[-1].strip().lower() for k, t in zip(kinds, texts, strict=True) if k == "crumb" and "›" in t), "")


#: What a walk along a page's lines has to remember: whether the two lines before were menu entries; whether a box is closed, just headed,
#: holds numbered items or holds titles; whether the headline is settled; what the last box was (0 none or numbered, 1 of one title, 2 of
#: more), its last title's line, and the line that turned out to be the headline.
START = (False, False, 0, False, 0, None, None)
CLOSED, HEADED, NUMBERED, TITLES = range(4)


def walk(kinds: list[str | None], texts: list[str], keys: list, state: tuple, ahead: tuple[bool, bool], crumb: str) -> tuple[list[str | None], tuple]:
    """Roles of lines that aren't blank with their neighbours taken into account, and what to remember after them.

    From left to right: a site's own short word between or beside menu entries
    that stand one per line is an entry too; titles after a box's heading are
    its items, up to the page's own headline (named by the breadcrumb) or the
    first text.  ``ahead`` tells whether the next two lines after these are
    menu entries, and ``keys`` names the lines, so that a page can be walked
    in parts with the same result.
    """
    a2, a1, box, settled, run, last, shown = state
    out, n = list(kinds), len(kinds)
    for i, kind in enumerate(kinds):
        if kind is None:
            text = texts[i]
            if (a1 or a2 or i + 1 >= n or kinds[i + 1] == "nav") and len(text) < 25 and text.count(" ") < 2 and not _ends(text):
                b1 = kinds[i + 1] == "nav" if i + 1 < n else ahead[i + 1 - n]
                b2 = kinds[i + 2] == "nav" if i + 2 < n else ahead[i + 2 - n]
                if (a1 or b1) and a2 + a1 + b1 + b2 > 1:
                    kind = out[i] = "nav"
        if kind is None:
            item = False
            if box:
                first = box == HEADED
                if first:
                    box = NUMBERED if _NUMBERED.match(text) else TITLES
                if box == NUMBERED:
                    item = _NUMBERED.match(text) is not None
                else:
                    item = is_title(text) and not _is_headline(text, crumb)
                if item:
                    out[i] = "item"
                    run, last = (0, None) if box == NUMBERED else (1 if first else 2, keys[i])
                else:
                    box = CLOSED
            if not item and not settled:
                # a page begins with its headline: where no other title stands before its first text, that of the last box before is it
                if run == 2 and not is_title(text):
                    shown = last
                settled = True
        else:
            box = HEADED if kind == "box" else CLOSED
        a2, a1 = a1, kind == "nav"
    return out, (a2, a1, box, settled, run, last, shown)


def last_shown(state: tuple):
    """The line, if any, that is the headline and not an item after all, as far as the end of a page tells."""
    _, _, box, settled, run, last, shown = state
    return last if not settled and run == 2 and box != TITLES else shown


def _is_headline(text: str, crumb: str) -> bool:
    """Whether a title is the one that a breadcrumb names."""
    n = min(len(crumb), len(text)) * 2 // 3
    return len(crumb) > 12 and crumb[:n] == text.lower()[:n]


# -- tree and rendering ----------------------------------------------------------------------------------------


@dataclass
class Element:
    tag: str
    children: list[Element] = field(default_factory=list)
    text: str = ""
    line_no: int = 0


_PARENT = {"li": "ul", "tr": "table", "td": "tr"}


def build(lines: list[tuple[int, str | None]], known: tuple[list[str | None], list[str]] | None = None) -> Element:
    """The tree of a page's lines; blank lines end open lists and tables.  Lines that have their tags get it from these.

    ``known`` are the lines' ``roles`` where the caller has them already.
    """
    if known is None and is_markup(lines):
        return _from_markup(lines)
    body = Element("body")
    kinds, texts = known or roles([x for _, x in lines])
    seen_text = False
    for (line_no, raw), kind, text in zip(lines, kinds, texts, strict=True):
        last = body.children[-1] if body.children else None
        if kind == "blank":
            body.children.append(Element("br", line_no=line_no))
            continue
        if kind in HIDDEN:
            tag = HIDDEN[kind]
            parent = last if last is not None and last.tag == tag and kind not in ("box", "teaser") else None
        else:
            tag = _PARENT.get(inner := _article_tag(raw or "", text, seen_text), inner)
            seen_text |= inner == "p"
            parent = last if tag != inner and last is not None and last.tag == tag else None
        if parent is None:
            parent = Element(tag)
            body.children.append(parent)
        if kind in HIDDEN or tag != inner:
            child = Element("span" if kind in HIDDEN else inner, text=text, line_no=line_no)
            if tag == "table":
                child.children = [Element("td", text=c.strip()) for c in re.split(r"\||\t", raw or "") if c.strip()]
            parent.children.append(child)
        else:
            parent.text, parent.line_no = text, line_no
    return body


def _from_markup(lines: list[tuple[int, str | None]]) -> Element:
    """The tree of lines with tags: hidden elements first by their tags, then by what the text in them is.

    A line is hidden if all text on it is, and if it has nothing but tags.
    """
    body, blocks = Element("body"), markup.blocks(lines)
    visible_ = [b for b in blocks if not b.hidden]
    kinds, _ = roles([b.text for b in visible_])
    for b, kind in zip(visible_, kinds, strict=True):
        # headings are not items of a box, and rows and preformatted text no prompts
        b.hidden = HIDDEN.get(kind, "") if not (b.tag in ("tr", "pre") or b.tag == "h" and kind == "item") else ""
    shown = {n for b in blocks if not b.hidden for n in b.lines}
    seen_text = False
    for b in blocks:
        if b.hidden:
            continue
        last = body.children[-1] if body.children else None
        if b.tag in ("li", "tr"):
            tag = _PARENT[b.tag]
            if last is None or last.tag != tag:
                last = Element(tag)
                body.children.append(last)
            last.children.append(Element(b.tag, [Element("td", text=c) for c in b.cells], b.mark + b.text, b.lines[0] if b.lines else 0))
        else:
            tag = ("h2" if seen_text else "h1") if b.tag == "h" else "pre" if b.tag == "pre" else "p"
            seen_text |= tag == "p"
            body.children.append(Element(tag, text=b.text, line_no=b.lines[0] if b.lines else 0))
    why = {n: b.hidden for b in reversed(blocks) if b.hidden for n in b.lines}
    for n, x in lines:
        if x and x.strip() and n not in shown:
            tag = why.get(n, "aside")
            body.children.append(Element(tag if tag in _HIDDEN_TAGS else "aside", [Element("span", text=x, line_no=n)]))
    return body


def _article_tag(raw: str, text: str, seen_text: bool) -> str:
    if raw[0] in "│├└─┌ " and _TREE.match(raw):
        return "pre"
    if "|" in text and _ROW.search(text):
        return "tr"
    if (text[0] in "-*•‣–—" or text[0].isdigit()) and _LIST.match(text):
        return "li"
    if is_title(text):
        return "h2" if seen_text else "h1"
    return "p"


_HIDDEN_TAGS = frozenset(HIDDEN.values())


def visible(element: Element) -> bool:
    return element.tag not in _HIDDEN_TAGS


def render(body: Element) -> str:
    """Text of the visible elements: blocks apart, list items and rows below each other, cells in columns."""
    out: list[str] = []
    for e in body.children:
        if not visible(e) or e.tag == "br":
            continue
        if e.tag == "ul":
            block = "\n".join(c.text for c in e.children)
        elif e.tag == "table":
            widths: list[int] = []
            for row in e.children:
                for i, c in enumerate(row.children):
                    if i == len(widths):
                        widths.append(0)
                    widths[i] = max(widths[i], len(c.text))
            block = "\n".join(" | ".join(c.text.ljust(w) for c, w in zip(row.children, widths, strict=False)).rstrip() for row in e.children)
        else:
            block = e.text
        out.append(block)
    return "\n\n".join(out)


def hidden_lines(lines: list[tuple[int, str | None]]) -> list[int]:
    """Numbers of the lines under hidden elements of the tree."""
    return [c.line_no for e in build(lines).children if not visible(e) for c in e.children]
