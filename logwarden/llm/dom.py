"""Web pages as trees of block elements with their runs of text."""

from __future__ import annotations

import html
import re

#: Elements that break the text into blocks; fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Elements whose content is no markup and never shown as text of the page.
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
#: Elements without text of the page, whatever they hold.
MUTE = frozenset("audio button canvas datalist head math noscript object option select svg template video".split())
#: Elements that have no end tag.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Form controls; they are counted.
CONTROLS = frozenset("button input option select textarea".split())
#: An element of the key closes an open one of the values, up to an element of the second set.
CLOSES: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tr": (frozenset(["tr"]), frozenset("table tbody thead tfoot".split())),
    "tbody": (frozenset("tbody thead tfoot".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: The end tag of an inline element and a new paragraph close nothing beyond these.
SCOPE = frozenset("article aside body blockquote button details dialog div fieldset figure footer form header html li main nav section table td th".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


class Node:
    """A block element, or a run of text without markup (``tag`` is empty)."""

    __slots__ = ("tag", "attributes", "parent", "depth", "text", "chars", "linked", "controls", "paragraphs")

    def __init__(self, tag: str, attributes: str, parent: int, depth: int):
        self.tag, self.attributes, self.parent, self.depth = tag, attributes, parent, depth
        self.text = ""
        self.chars = self.linked = self.controls = self.paragraphs = 0


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a start tag with their values, names in lower case; the first of several counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


class _Builder:
    def __init__(self) -> None:
        self.nodes = [Node("html", "", -1, 0)]
        self.stack: list[tuple[str, int]] = [("html", 0)]  # name, its node or that of the block around it
        self.open: dict[str, int] = {"html": 1}
        self.muted = self.links = 0
        self.parts: list[tuple[str, bool]] = []

    def flush(self) -> None:
        """Make a text node of what has been read since the last edge of a block."""
        if self.parts:
            text = " ".join("".join([p for p, _ in self.parts]).split())
            if text:
                around = self.stack[-1][1]
                node = Node("", "", around, self.nodes[around].depth + 1)
                node.text, node.chars = text, len(text)
                node.linked = min(len(text), sum(len(p.strip()) for p, linked in self.parts if linked))
                self.nodes.append(node)
            self.parts = []

    def push(self, tag: str, raw: str) -> None:
        at = self.stack[-1][1]
        if tag in BLOCKS:
            self.flush()
            if not self.muted:
                self.nodes.append(Node(tag, raw, at, self.nodes[at].depth + 1))
                at = len(self.nodes) - 1
        self.stack.append((tag, at))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.muted += tag in MUTE
        self.links += tag == "a"

    def pop(self) -> None:
        tag, _ = self.stack[-1]
        if tag in BLOCKS:
            self.flush()
        self.stack.pop()
        self.open[tag] -= 1
        self.muted -= tag in MUTE
        self.links -= tag == "a"

    def close(self, names: frozenset | set, until: frozenset | set) -> None:
        """Close the innermost open element of ``names`` with all inside it, unless one of ``until`` is nearer."""
        if not any(self.open.get(n) for n in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in names:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k][0] in until:
                return

    def start(self, tag: str, raw: str) -> None:
        if self.open.get("head") and tag not in IN_HEAD:
            self.close({"head"}, set())
        if tag == "html" or tag == "body" and self.open.get("body"):
            return
        if tag in BLOCKS:
            self.close({"p"}, SCOPE)
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        if tag in CONTROLS:
            self.nodes[self.stack[-1][1]].controls += 1
        if tag == "a" and self.links:
            self.end("a")
        if tag == "br":
            self.text(" ")
        elif tag in VOID:
            if tag in BLOCKS:
                self.flush()
        else:
            self.push(tag, raw)

    def end(self, tag: str) -> None:
        if tag in ("html", "body") or not self.open.get(tag):
            return
        if tag in BLOCKS or tag in MUTE:
            self.close({tag}, set())
            return
        # An inline element that is around blocks ends, and the blocks go on.
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k][0]
            if name == tag:
                del self.stack[k]
                self.open[tag] -= 1
                self.links -= tag == "a"
                return
            if name in SCOPE:
                return

    def text(self, part: str) -> None:
        if self.stack[-1][0] == "head" and part.strip():
            self.close({"head"}, set())
        if not self.muted:
            self.parts.append((part, self.links > 0))


def parse(page: str) -> list[Node]:
    """Nodes of a page, parents before children and text in page order.

    Any text is a page: end tags may lack or be in excess, a comment without its end reaches
    to the end of the page, and so do script, style and the like. Node 0 is the page itself.
    """
    out, at, end = _Builder(), 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            out.text(html.unescape(page[at:]))
            break
        if found.start() > at:
            out.text(html.unescape(page[at : found.start()]))
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name, closing, raw = name.lower(), found[1] or found[4], found[3] or found[6] or ""
        if closing:
            out.end(name)
            continue
        if name not in RAW:
            out.start(name, raw)
            continue
        out.nodes[out.stack[-1][1]].controls += name in CONTROLS
        stop = _RAW_ENDS[name].search(page, at)
        at = stop.end() if stop else end
    out.flush()
    nodes = out.nodes
    for node in reversed(nodes):
        if node.parent >= 0:
            around = nodes[node.parent]
            around.chars += node.chars
            around.linked += node.linked
            around.controls += node.controls
            around.paragraphs += node.tag == "p"
    return nodes
