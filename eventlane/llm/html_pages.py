"""Labelled pages for training the extractor: common layouts, filled with seeded text.

A labelled page is its html and, for each leaf block in page order, whether the
block is main text.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field


@dataclass
class Page:
    """Html that is built up together with the labels of its blocks."""

    html: list[str] = field(default_factory=list)
    labels: list[bool] = field(default_factory=list)

    def raw(self, markup: str) -> None:
        self.html.append(markup)

    def block(self, tag: str, inner: str, main: bool, attributes: str = "", close: bool = True) -> None:
        self.html.append(f"<{tag}{attributes}>{inner}" + (f"</{tag}>" if close else ""))
        self.labels.append(main)


class Maker:
    """Pages of one seed."""

    def __init__(self, seed: int) -> None:
        self.draw = random.Random(seed)
        parts = ["".join(self.draw.choices("aeiou" if i % 2 else "bcdfglmnprst", k=self.draw.choice((1, 1, 2)))) for i in range(60)]
        self.vocabulary = ["".join(self.draw.choices(parts, k=self.draw.randint(1, 4))) for _ in range(400)]

    def words(self, low: int, high: int) -> str:
        n = self.draw.randint(low, high)
        found = [self.draw.choice(self.vocabulary) for _ in range(n)]
        for i in range(0, n, 9):
            found[i] = found[i].capitalize()
            if i:
                found[i - 1] += self.draw.choice((".", ".", ",", "?"))
        mark = self.draw.choice(("", "", "", "%%%", "&amp;&amp;", " |"))
        return " ".join(w + mark for w in found)

    def chance(self, share: float) -> bool:
        return self.draw.random() < share

    def links(self, page: Page, n: int, item: str = "li") -> None:
        for _ in range(n):
            text = self.words(1, 2)
            if item == "a":
                # Links side by side in one line are one block.
                page.raw(f'<a href="/{text[:5]}">{text}</a> ')
            else:
                page.block(item, f'<a href="/{text[:5]}">{text}</a>', False)
        if item == "a":
            page.labels.append(False)

    def menu(self, page: Page) -> None:
        outer = self.draw.choice(("<nav>", '<div class="menu">', '<div id="navigation">', '<ul class="nav navbar">', '<div role="navigation">'))
        page.raw(outer + ("<ul>" if self.chance(0.6) else ""))
        self.links(page, self.draw.randint(2, 8), self.draw.choice(("li", "li", "a", "div")))
        page.raw("</ul></nav></div>" if "ul" not in outer else "</ul>")

    def extra(self, page: Page) -> None:
        """One thing beside the article."""
        kind = self.draw.randrange(8)
        text = self.words(3, 30)
        if kind == 0:
            page.block("div", text, False, self.draw.choice((' class="ad"', ' class="advert"', ' class="ads banner"', ' id="sponsor"', ' class="promo"')))
        elif kind == 1:
            outer = self.draw.choice(("<aside>", '<div class="sidebar">', '<div id="sidebar" class="widget">'))
            page.raw(outer)
            page.block("h3", self.words(1, 3), False)
            self.links(page, self.draw.randint(1, 5))
            if self.chance(0.6):
                page.block("p", text, False)
            page.raw("</aside>" if outer == "<aside>" else "</div>")
        elif kind == 2:
            page.block("div", text, False, self.draw.choice((' class="cookie-notice"', ' id="consent"', ' class="notice"', ' class="alert banner"', ' role="alert"')))
        elif kind == 3:
            page.raw('<form action="/search">')
            page.block("label", self.words(1, 3), False)
            page.raw("<input type=text><button>Go</button></form>")
        elif kind == 4:
            page.raw(self.draw.choice(('<section class="comments">', '<div id="comments">', '<div class="comment-list">', '<section id="discussion" class="responses">')))
            page.block("h2", self.words(1, 3), False)
            for _ in range(self.draw.randint(1, 4)):
                page.raw(self.draw.choice(('<div class="comment">', '<article class="comment">', '<li class="reply">')))
                page.block("p", self.words(4, 40), False)
                page.raw("</div></article></li>")
            page.raw("</section></div>")
        elif kind == 5:
            page.raw(self.draw.choice(('<div class="related">', '<div class="share social">', '<section class="more-links">')))
            self.links(page, self.draw.randint(2, 5))
            page.raw("</div></section>")
        elif kind == 6:
            page.raw(self.draw.choice(('<div class="newsletter">', '<div class="subscribe modal">')))
            page.block("p", text, False)
            page.raw("</div>")
        else:
            page.block("div", self.words(1, 4) + " &gt; " + self.words(1, 3), False, ' class="breadcrumb"')

    def body(self, page: Page) -> None:
        outer, end = self.draw.choice((
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
            ('<div class="content">', "</div>"), ('<div class="post entry">', "</div>"), ('<div id="article-body">', "</div>"),
            ('<div class="story text">', "</div>"), ('<section class="main">', "</section>"), ("<div>", "</div>"),
        ))
        page.raw(outer)
        if self.chance(0.8):
            page.block("h1", self.words(2, 9), True)
        for i in range(self.draw.randint(1, 12)):
            kind = self.draw.random()
            if kind < 0.68:
                text = self.words(1, 4) if self.chance(0.15) else self.words(8, 90)
                if self.chance(0.2):
                    text = text[: len(text) // 2] + f' <a href="/x">{self.words(1, 3)}</a> ' + self.words(3, 20)
                if self.chance(0.2):
                    page.block("p", f"<b>{text}<br>", True, close=False)
                else:
                    page.block("p", text, True)
            elif kind < 0.78:
                page.block(self.draw.choice(("h2", "h3")), self.words(1, 6), True)
            elif kind < 0.88:
                page.raw("<ul>")
                for _ in range(self.draw.randint(1, 5)):
                    page.block("li", self.words(2, 20), True)
                page.raw("</ul>")
            elif kind < 0.92:
                page.block("blockquote", self.words(5, 40), True)
            elif kind < 0.95:
                page.block("pre", self.words(3, 20), True)
            elif kind < 0.97:
                page.raw("<table><tr>")
                page.block("td", self.words(1, 6), True)
                page.block("td", self.words(1, 6), True)
                page.raw("</tr></table>")
            elif i:
                self.extra(page)
        page.raw(end)

    def page(self) -> tuple[str, list[bool]]:
        page = Page()
        page.raw(f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>")
        if self.chance(0.4):
            page.raw(self.draw.choice(("<header>", '<div class="header">', '<div id="masthead">')))
            if self.chance(0.7):
                page.block("h1" if self.chance(0.3) else "div", self.words(1, 4), False)
            if self.chance(0.6):
                page.block("p", self.words(2, 10), False)
            page.raw("</header></div>")
        if self.chance(0.8):
            self.menu(page)
        for _ in range(self.draw.choice((0, 1, 1, 2))):
            self.extra(page)
        if self.chance(0.97):
            self.body(page)
        for _ in range(self.draw.choice((0, 0, 1, 2, 3))):
            self.extra(page)
        if self.chance(0.8):
            outer = self.draw.choice(("<footer>", '<div class="footer">', '<div id="footer">'))
            inner = f"&copy; {self.words(1, 3)}.example &middot; {self.words(2, 14)}"
            page.raw(outer)
            if self.chance(0.5):
                page.raw(inner)
                page.labels.append(False)
            else:
                page.block("p", inner, False)
                if self.chance(0.5):
                    self.links(page, self.draw.randint(1, 4))
            page.raw("</footer></div>")
        if self.chance(0.9):
            page.raw("</body></html>")
        return "".join(page.html), page.labels


def labelled_pages(count: int, seed: int = 3) -> list[tuple[str, list[bool]]]:
    """``count`` labelled pages, the same for the same seed."""
    return [Maker(seed * 100_003 + i).page() for i in range(count)]
