"""Made-up web pages with known main text, from a seed: what the extraction model learns from.

Each page is assembled from parts in varying order and nesting, with varying tags and attribute words, and each text is
marked as belonging to the article or not. Words are made up, so nothing but the structure can be learnt; texts outside the article are in
Greek letters, of which the features see nothing but their number.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

_SYLLABLES = "ba co di fe gu ha in jo ka le mi no or pe qui ra so tu ve wa xe yo za ent ing tion ment".split()
#: Attribute words by part, as publishers commonly choose them.
NAMES = {
    "article": "article post entry story content main-content article-body post-body entry-content story-text text body single-post article__content main".split(),
    "menu": "nav navbar menu main-menu navigation breadcrumb breadcrumbs tabs pager pagination topnav site-nav toc".split(),
    "header": "header site-header masthead page-header branding topbar logo head".split(),
    "footer": "footer site-footer page-footer copyright legal bottom colophon credits".split(),
    "sidebar": "sidebar side aside rail widget widget-area related related-posts recommended secondary col-right trending popular share social-share more-links".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal overlay warning info-bar newsletter-signup paywall message announcement".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo banner ad-slot adsbox google-ad promoted commercial".split(),
    "form": "form search search-form login signup subscribe contact-form newsletter subscription".split(),
    "comments": "comments comment comment-list comments-area responses discussion replies disqus reader-comments thread respond".split(),
}
#: For each of a to z another letter, which marks a text as not of the article.
OUTSIDE = {ord("a") + k: 0x3B1 + k if k < 25 else 0x3D1 for k in range(26)} | {ord("A") + k: 0x391 + k if k not in (17, 25) else 0x3DE for k in range(26)}
_TAGS = {
    "menu": ["nav", "nav", "div", "ul", "section"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "sidebar": ["aside", "aside", "div", "section"],
    "notice": ["div", "div", "section", "p", "dialog"], "advert": ["div", "div", "aside", "section", "p"], "form": ["form", "form", "div"], "comments": ["section", "div", "ol", "aside"],
}


@dataclass
class Maker:
    rng: random.Random
    html: list[str] = field(default_factory=list)
    main: list[str] = field(default_factory=list)

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self) -> str:
        words = self.words(1, 25).split(" ")
        marked = [w + "," if self.rng.random() < 0.08 else w for w in words[:-1]] + [words[-1] + "."]
        return " ".join(marked).capitalize()

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def outside(self, low: int, high: int) -> str:
        return self.words(low, high).translate(OUTSIDE)

    def put(self, text: str, main: bool) -> None:
        """A text, sometimes with parts of it in inline elements."""
        if main:
            self.main.append(text)
        else:
            text = text.translate(OUTSIDE)
        words = text.split(" ")
        if self.rng.random() < 0.25 and len(words) > 3:
            k = self.rng.randrange(len(words) - 1)
            words[k] = self.rng.choice(('<a href="/{0}">{0}</a>', "<b>{0}</b>", "<i>{0}</i>", '<span class="hl">{0}</span>')).format(words[k])
        self.html.append(" ".join(words))

    def opening(self, part: str, tag: str, named: float = 0.75) -> str:
        r = self.rng
        if r.random() > named:
            return f"<{tag}>"
        name = r.choice(NAMES[part])
        return f"<{tag} " + r.choice((f'class="{name}"', f'id="{name}"', f'class="{name} {self.word()}"', f'class="{self.word()}-{name}"')) + ">"

    def block(self, tag: str, text: str, main: bool) -> None:
        self.html.append(f"<{tag}>")
        self.put(text, main)
        if not (tag in ("p", "li") and self.rng.random() < 0.1):
            self.html.append(f"</{tag}>")

    def links(self, n: int) -> None:
        for _ in range(n):
            self.html.append(f'<li><a href="/{self.word()}">{self.outside(1, 3)}</a></li>')

    def part(self, part: str) -> None:
        """Something that is not the article."""
        r = self.rng
        tag = r.choice(_TAGS[part])
        plain = tag in ("nav", "header", "footer", "aside", "form", "dialog")
        self.html.append(self.opening(part, tag, 0.6 if plain else 1.0))
        if part == "menu":
            listed = tag != "ul" and r.random() < 0.8
            self.html.append("<ul>" * listed)
            self.links(r.randint(2, 9))
            self.html.append("</ul>" * listed)
        elif part == "header":
            if r.random() < 0.7:
                self.block(r.choice(("h1", "h2", "p", "div")), self.words(1, 4), False)
            if r.random() < 0.6:
                self.block("p", self.prose(1), False)
            if r.random() < 0.4:
                self.part("menu")
        elif part == "footer":
            if r.random() < 0.6:
                self.html.append(f"&copy; {self.outside(1, 1)} &middot; " + self.prose(1).translate(OUTSIDE))
            else:
                self.block("p", f"© {self.words(1, 3)} {r.randint(1990, 2030)} {self.prose(2)}", False)
            if r.random() < 0.3:
                self.html.append("<ul>")
                self.links(r.randint(2, 6))
                self.html.append("</ul>")
        elif part == "sidebar":
            if r.random() < 0.7:
                self.block(r.choice(("h2", "h3", "h4", "p")), self.words(1, 4), False)
            if r.random() < 0.6:
                self.html.append("<ul>")
                self.links(r.randint(2, 8))
                self.html.append("</ul>")
            else:
                for _ in range(r.randint(1, 3)):
                    self.block("p", self.prose(2), False)
        elif part in ("notice", "advert"):
            if tag == "p" or r.random() < 0.5:
                self.put(self.prose(2), False)
            else:
                if r.random() < 0.4:
                    self.block("h3", self.words(1, 4), False)
                self.block(r.choice(("p", "div", "span")), self.prose(2), False)
            if r.random() < 0.3 and tag != "p":
                self.html.append(f"<button>{self.outside(1, 2)}</button>")
        elif part == "form":
            for _ in range(r.randint(1, 3)):
                self.html.append(f'<label>{self.outside(1, 3)}</label><input type="text">')
            if r.random() < 0.3:
                self.html.append("<select>" + "".join(f"<option>{self.outside(1, 1)}</option>" for _ in range(3)) + "</select>")
            if r.random() < 0.3:
                self.block("p", self.prose(1), False)
            self.html.append(f"<button>{self.outside(1, 2)}</button>")
        else:  # comments
            if r.random() < 0.7:
                self.block(r.choice(("h2", "h3")), self.words(1, 3), False)
            inner = "li" if tag == "ol" else r.choice(("div", "article", "p", "li"))
            for _ in range(r.randint(1, 5)):
                self.html.append(self.opening("comments", inner, 0.6))
                if inner != "p":
                    if r.random() < 0.6:
                        self.block(r.choice(("b", "span", "h4", "cite")), self.words(1, 2), False)
                    self.block("p", self.prose(3), False)
                else:
                    self.put(self.prose(3), False)
                self.html.append(f"</{inner}>")
            if r.random() < 0.3:
                self.part("form")
        self.html.append(f"</{tag}>")

    def article(self, inside: list[str]) -> None:
        """The article, with other parts between its blocks."""
        r = self.rng
        tag = r.choice(("article", "article", "main", "div", "section"))
        self.html.append(self.opening("article", tag, 0.4 if tag in ("article", "main") else 1.0))
        if r.random() < 0.8:
            framed = r.random() < 0.15
            self.html.append("<header>" * framed)
            self.block("h1", self.words(1, 14), True)
            self.html.append("</header>" * framed)
        if wrapped := r.random() < 0.3:
            self.html.append(self.opening("article", "div", 0.7))
        kinds = r.choices(("p", "h2", "list", "quote", "bare", "table", "pre", "figure", "dl"), (60, 8, 7, 4, 4, 2, 2, 2, 1), k=r.choice((1, 1, 2, 3, 5, 8, 14)))
        if kinds[0] != "p" and r.random() < 0.8:
            kinds[0] = "p"
        slots = {r.randrange(1, len(kinds) + 1): part for part in inside}
        for k, kind in enumerate(kinds, 1):
            if kind == "p":
                self.html.append("<p>")
                if r.random() < 0.1:
                    self.html.append("<b>")  # never closed
                self.put(self.prose(r.choice((1, 3, 8, 30))) if r.random() < 0.85 else self.words(1, 4), True)
                self.html.append(r.choice(("</p>", "</p>", "</p>", "<br>")))
            elif kind == "h2":
                self.block(r.choice(("h2", "h3", "h4")), self.words(1, 7), True)
            elif kind == "list":
                outer = r.choice(("ul", "ol"))
                self.html.append(f"<{outer}>")
                for _ in range(r.randint(2, 6)):
                    self.block("li", self.prose(2) if r.random() < 0.5 else self.words(1, 6), True)
                self.html.append(f"</{outer}>")
            elif kind == "quote":
                self.html.append("<blockquote>")
                self.block("p", self.prose(2), True)
                self.html.append("</blockquote>")
            elif kind == "table":
                self.html.append("<table>")
                for _ in range(r.randint(1, 4)):
                    self.html.append("<tr>")
                    for _ in range(2):
                        self.block("td", self.words(1, 5), True)
                    self.html.append("</tr>")
                self.html.append("</table>")
            elif kind == "pre":
                self.block("pre", self.words(3, 20), True)
            elif kind == "figure":
                self.html.append('<figure><img src="/x.png">')
                self.block("figcaption", self.words(3, 12), True)
                self.html.append("</figure>")
            elif kind == "dl":
                self.html.append("<dl>")
                self.block("dt", self.words(1, 3), True)
                self.block("dd", self.prose(2), True)
                self.html.append("</dl>")
            else:
                self.html.append("<div>" if (boxed := r.random() < 0.6) else "")
                self.put(self.prose(4), True)
                self.html.append("</div>" if boxed else "<br><br>")
            if k in slots:
                self.part(slots[k])
        self.html.append("</div>" * wrapped + f"</{tag}>")


def make_page(seed: int) -> tuple[str, str]:
    """A page's HTML and its main text."""
    m = Maker(random.Random(seed))
    r = m.rng
    m.html.append(f'<!DOCTYPE html><html><head><title>{m.words(2, 8)}</title><style>p{{}}</style><script>var x = "</p>";</script></head><body>')
    before = [p for p, share in (("notice", 0.25), ("header", 0.45), ("menu", 0.75), ("advert", 0.4), ("form", 0.2)) if r.random() < share]
    after = [p for p, share in (("sidebar", 0.4), ("advert", 0.25), ("comments", 0.35), ("form", 0.2), ("menu", 0.2), ("footer", 0.75), ("notice", 0.2)) if r.random() < share]
    if r.random() < 0.3:
        r.shuffle(before)
    if r.random() < 0.3:
        r.shuffle(after)
    if after and r.random() < 0.15:
        before.append(after.pop(0))
    inside = [p for p in ("advert", "sidebar", "form", "notice", "comments", "menu") if r.random() < 0.1]
    wrap = r.choice(("", "", "div", "main"))
    for p in before:
        m.part(p)
        if r.random() < 0.1:
            m.html.append("<!-- <p>no text</p> -->")
    m.html.append(f'<{wrap} class="{r.choice(("wrapper", "container", "page", "row", "layout"))}">' if wrap else "")
    if wrap and r.random() < 0.3:
        m.part(r.choice(("sidebar", "menu", "advert")))
    m.article(inside)
    if wrap and r.random() < 0.4:
        m.part(r.choice(("sidebar", "comments", "form")))
    m.html.append(f"</{wrap}>" if wrap else "")
    for p in after:
        m.part(p)
    m.html.append("</body></html>" if r.random() < 0.9 else "")
    return "".join(m.html), " ".join(m.main)


def make_bare(seed: int) -> tuple[str, str]:
    """A page of little layout and its main text: plain text, paragraphs right in the body, a single block, or cells of a
    table in which a menu and the article stand side by side."""
    m = Maker(random.Random(f"bare {seed}"))
    r = m.rng
    kind = r.choice(("text", "paragraphs", "paragraphs", "block", "lines", "cells"))
    head = r.choice(("", "<html><body>", f"<html><head><title>{m.words(1, 6)}</title></head><body>", f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{m.words(1, 6)}</title></head><body>"))
    m.html.append(head)
    if kind == "text":
        m.put(m.prose(r.choice((1, 2, 6))), True)
    elif kind == "lines":
        tag = r.choice(("", "center", "font", "pre"))
        m.html.append(f"<{tag}>" * bool(tag))
        for _ in range(r.randint(1, 8)):
            m.put(m.prose(3), True)
            m.html.append(r.choice(("<br>", "<br><br>", "<hr>", "<br/>")))
        m.html.append(f"</{tag}>" * bool(tag))
    elif kind == "cells":
        m.html.append("<table><tr>")
        sides = ["menu", "article"] if r.random() < 0.7 else ["article", "menu"]
        for side in sides:
            m.html.append(r.choice(("<td>", '<td valign="top">', '<td width="20%">')))
            if side == "menu":
                for _ in range(r.randint(3, 9)):
                    m.html.append(f'<a href="/{m.word()}">{m.outside(1, 3)}</a><br>')
            else:
                if r.random() < 0.6:
                    m.block(r.choice(("h1", "h2")), m.words(1, 8), True)
                for _ in range(r.randint(1, 8)):
                    m.block("p", m.prose(r.choice((1, 3, 8))), True)
            m.html.append("</td>")
        m.html.append("</tr></table>")
    else:
        boxed = kind == "block"
        tag = r.choice(("div", "div", "section", "main"))
        m.html.append(f"<{tag}>" if boxed else "")
        if r.random() < 0.6:
            m.block(r.choice(("h1", "h1", "h2")), m.words(1, 10), True)
        for _ in range(r.choice((1, 1, 2, 4, 9))):
            if r.random() < 0.85:
                m.block("p", m.prose(r.choice((1, 1, 3, 8))), True)
            else:
                m.html.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    m.block("li", m.words(1, 8), True)
                m.html.append("</ul>")
        m.html.append(f"</{tag}>" if boxed else "")
        if r.random() < 0.25:
            m.part("menu" if r.random() < 0.5 else "footer")
    m.html.append("</body></html>" if head and r.random() < 0.8 else "")
    return "".join(m.html), " ".join(m.main)
