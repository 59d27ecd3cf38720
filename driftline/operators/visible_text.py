"""The visible lines of a page, from one parser pass: blocks break lines, preformatted text keeps its breaks, and items that markup sets
side by side without a blank are lines of their own."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

#: Elements whose text isn't shown, elements that don't break a line, elements without content, and elements that keep
#: their text as it is written (the first of which keep line breaks too).
HIDDEN = {"script", "style", "noscript", "template", "svg", "head", "iframe", "textarea", "select"}
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BREAKS_KEPT = {"pre", "listing", "xmp"}
AS_WRITTEN = BREAKS_KEPT | {"code", "kbd", "samp"}
#: Elements within running text: two of them side by side are one word, not two items.
PHRASES = set("abbr b bdi bdo cite code data del dfn em font i img ins kbd mark q s samp small strike strong sub sup time tt u var wbr".split())
#: An element that a new one of these ends, up to the element that holds both.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
#: A reference to a sign, by number or by name.
_REFERENCE = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")


def _written_out(reference: re.Match) -> str:
    """A reference that is whole, or &amp; the sign of any other is written out, so that it is read as the text that it is."""
    own = reference[0]
    return own if own.startswith("&amp") or own[-1] == ";" and (own[1] == "#" or own[1:] in html5) else "&amp;" + own[1:]


class _Element:
    """An element with its children (texts and elements), whether it shows, and the first and last character and whether there is a letter
    in what it shows."""

    __slots__ = ("children", "first", "last", "letter", "shown", "tag")

    def __init__(self, tag: str, shown: bool):
        self.tag, self.shown, self.children = tag, shown, []
        self.first = self.last = ""
        self.letter = False

    def add_edges(self, first: str, last: str, letter: bool) -> None:
        self.first, self.last, self.letter = self.first or first, last or self.last, self.letter or letter


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Element("", True)
        self.open = [self.root]

    def _close(self) -> None:
        own = self.open.pop()
        if own.shown:
            self.open[-1].add_edges(own.first, own.last, own.letter)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            ended, holders = ENDS[tag]
            k = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag in ended | holders), 0)
            if k and self.open[k].tag in ended:
                while len(self.open) > k:
                    self._close()
        if self.open[-1].tag == "p" and tag not in INLINE:
            self._close()
        a = dict(attrs)
        shown = not (tag in HIDDEN or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", ""))
        own = _Element(tag, shown)
        self.open[-1].children.append(own)
        if tag not in VOID:
            self.open.append(own)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if any(x.tag == tag for x in self.open[1:]):
            while self.open[-1].tag != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        own = self.open[-1]
        own.children.append(data)
        if data:
            own.add_edges(data[0], data[-1], any(c.isalpha() for c in data))

    def closed(self) -> _Element:
        while len(self.open) > 1:
            self._close()
        return self.root


def _holds_items(own: _Element) -> bool:
    """Whether children stand side by side without a blank, one at least with a letter, and none of them is a phrase of running text."""
    if any(isinstance(x, str) and x.strip() for x in own.children):
        return False
    before: _Element | None = None
    for x in own.children:
        if isinstance(x, str) or not x.shown or x.tag in PHRASES:
            before = None
        elif x.first:
            if before and (before.letter or x.letter) and not before.last.isspace() and not x.first.isspace():
                return True
            before = x
    return False


def lines_of_page(html: str | None, unclosed: bool = True) -> list[str]:
    """The lines of a page, blanks collapsed, without empty ones. Memory and time are linear in the page. A reference that lacks its
    semicolon ('&quot') is read as browsers do, or with unclosed=False stays as it is written, but for '&amp'."""
    tree = _Tree()
    tree.feed((html or "") if unclosed else _REFERENCE.sub(_written_out, html or ""))
    tree.close()
    lines: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(parts).replace("​", "").split()):
            lines.append(line)
        parts.clear()

    # (element, next child, breaks kept, as written, children are items, breaks lines itself)
    stack = [[tree.closed(), 0, False, False, False, False]]
    while stack:
        own, k, kept, written, items, breaks = top = stack[-1]
        if k == len(own.children):
            stack.pop()
            if breaks:
                flush()
            continue
        top[1] += 1
        child = own.children[k]
        if isinstance(child, str):
            for n, piece in enumerate(re.split(r"\r\n|\r|\n", child) if kept else [child]):
                if n:
                    flush()
                parts.append(piece)
            continue
        parts_line = child.shown and (items or child.tag not in INLINE)
        if parts_line:
            flush()
        if child.shown and child.children:
            as_written = written or child.tag in AS_WRITTEN
            stack.append([child, 0, kept or child.tag in BREAKS_KEPT, as_written, not as_written and _holds_items(child), parts_line])
    flush()
    return lines
