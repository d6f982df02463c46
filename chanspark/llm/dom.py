"""A forgiving HTML reader: a flat list of nodes and the text pieces between them, in page order.

Elements that matter for a page's layout become nodes (numbered in page order, so a parent comes before its children);
plain inline formatting does not. Text is kept as pieces, each with the node it stands in; a piece of None marks a border
between blocks. Scripts, styles and other elements that never show text are left out. Reading is one pass over the tags
with a stack, without recursion, so neither depth nor length is limited.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup and never shown.
SILENT = frozenset("script style template noscript noembed noframes iframe object svg math audio video canvas title textarea xmp".split())
#: Elements that stand inside a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr label output meter progress".split()
)
#: An opening tag of these ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul search".split()
)
#: An opening tag of the key ends an open element of the value, unless one of the borders stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}
#: A closing tag does not reach past these.
FENCE = frozenset("table td th caption button object".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|--!>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']++|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z))", re.S)
_SHORT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Attributes whose words tell what an element is for.
TELLING = ("class", "id", "role", "aria-label", "itemprop", "data-role", "data-component")


@dataclass
class Page:
    """Parallel lists of nodes (tag, parent, words of their attributes) and of text pieces (node, text, inside a link)."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    n_inner: list[int] = field(default_factory=list)
    pieces: list[tuple[int, str | None, bool]] = field(default_factory=list)

    def text(self, chosen: list[bool] | None = None) -> str:
        """The pieces of the chosen nodes (all by default): white space as one space, blocks joined by one space."""
        parts = [" " if t is None else t for n, t, _ in self.pieces if t is None or chosen is None or chosen[n]]
        return " ".join("".join(parts).split())


def _attributes(source: str) -> tuple[str, bool]:
    """The words of an element's telling attributes, and whether it is hidden."""
    words, hidden = [], False
    for name, a, b, c in _ATTRIBUTE.findall(source):
        name = name.lower()
        if name in TELLING:
            words.append(html.unescape(a or b or c))
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", a or b or c)) or (name == "aria-hidden" and (a or b or c) == "true"):
            hidden = True
    return " ".join(words), hidden


def read(source: str | None) -> Page:
    """Reads a whole page; null counts as the empty page."""
    page = Page()
    source = (source or "").replace("\x00", "�")
    tags, parents, words, inner, pieces = page.tags, page.parents, page.words, page.n_inner, page.pieces
    tags.append("#page"), parents.append(-1), words.append(""), inner.append(0)
    # Open elements: tag, and the node that text inside them belongs to.
    stack: list[tuple[str, int]] = [("#page", 0)]
    opened: Counter[str] = Counter()
    endless: set[str] = set()  # elements whose closing tag does not come any more
    at, size = 0, len(source)
    unescape = html.unescape
    find = _TAG.search
    while at < size:
        m = find(source, at)
        start = m.start() if m else size
        if start > at:
            text = source[at:start]
            pieces.append((stack[-1][1], unescape(text) if "&" in text else text, opened["a"] > 0))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        attributes = m[3]
        if "<" in attributes and (n := _SHORT.match(source, start)) and n.end() < at:
            at, attributes = n.end(), n[3]  # a quote that is never closed must not swallow the page
        tag = m[2].lower()
        if m[1]:  # a closing tag
            if not opened[tag]:
                if tag in ("br", "p"):
                    pieces.append((stack[-1][1], None, False))
                continue
            k = len(stack) - 1
            inline = tag in INLINE
            while k > 0 and stack[k][0] != tag:
                if (stack[k][0] in FENCE and tag not in ("table", "body", "html", "tr", "tbody", "thead", "tfoot")) or (inline and stack[k][0] not in INLINE):
                    k = 0
                    break
                k -= 1
            if k > 0:
                closed = stack[k:]
                del stack[k:]
                opened.subtract(t for t, _ in closed)
                if any(t not in INLINE for t, _ in closed):
                    pieces.append((stack[-1][1], None, False))
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                pieces.append((stack[-1][1], None, False))
            inner[stack[-1][1]] += 1
            continue
        if tag in SILENT:
            if attributes.rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            if tag in ("svg", "math", "noscript", "object") and not end:
                endless.add(tag)
                continue  # its content is read as markup
            at = end.end() if end else size
            continue
        # What the opening tag ends without saying so.
        drop = None
        if tag in ENDS_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    drop = k
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in ENDS:
            ended, borders = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in borders:
                    break
                if stack[k][0] in ended:
                    drop = k
        if tag == "a" and opened["a"]:  # links do not nest
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "a":
                    drop = k
                    break
                if stack[k][0] not in INLINE:
                    break
        if drop is not None:
            opened.subtract(t for t, _ in stack[drop:])
            del stack[drop:]
        inline = tag in INLINE
        told, hidden = _attributes(attributes) if attributes else ("", False)
        node = stack[-1][1]
        if not inline or told or hidden:
            parents.append(node), tags.append(tag), words.append(told + (" hidden" if hidden else "")), inner.append(0)
            node = len(tags) - 1
        else:
            inner[node] += 1
        if not inline:
            pieces.append((node, None, False))
        stack.append((tag, node))
        opened[tag] += 1
    return page


def visible(page: Page) -> list[bool]:
    """For each node, whether it is outside the page's head."""
    out = [True] * len(page.tags)
    for n, (tag, parent) in enumerate(zip(page.tags, page.parents, strict=True)):
        out[n] = tag != "head" and (parent < 0 or out[parent])
    return out


def plain_text(source: str | None) -> str:
    """All the text that a page shows, blocks joined by line ends, white space inside a block as one space."""
    page = read(source)
    shown = visible(page)
    lines, line = [], []
    for n, t, _ in page.pieces:
        if t is None:
            lines.append("".join(line))
            line = []
        elif shown[n]:
            line.append(t)
    lines.append("".join(line))
    return "\n".join(x for x in (" ".join(y.split()) for y in lines) if x)
