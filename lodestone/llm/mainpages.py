"""Labelled pages for training the extraction of main text: made from templates, with a label for every text block."""

from __future__ import annotations

import random

SYLLABLES = ("an", "be", "co", "da", "el", "fi", "gor", "hu", "in", "ka", "lo", "mer", "no", "pe", "ra", "sti", "tu", "ver", "wo", "zi")


class Maker:
    """One page: pieces of HTML, and for each block of text whether it is the article's."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.html: list[str] = []
        self.labels: list[int] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high)))

    def prose(self, sentences: int) -> str:
        return " ".join(self.words(3, 14).capitalize() + "." for _ in range(sentences))

    def block(self, tag: str, text: str, label: int, attrs: str = "", closed: bool = True) -> None:
        self.html.append(f"<{tag}{attrs}>{text}" + f"</{tag}>" * closed)
        self.labels.append(label)

    def wrap(self, tag: str, names: tuple[str, ...], inside) -> None:
        name = self.r.choice(names)
        attr = f' {self.r.choice(("class", "id"))}="{name}"' if name else ""
        self.html.append(f"<{tag}{attr}>")
        inside()
        self.html.append(f"</{tag}>")

    def links(self, n: int) -> None:
        self.html.append("<ul>")
        for _ in range(n):
            self.block("li", f'<a href="/{self.r.randint(1, 99)}">{self.words(1, 3)}</a>', 0)
        self.html.append("</ul>")

    def noise(self) -> None:
        r = self.r
        kind = r.randrange(11)
        if kind == 0:
            self.wrap(r.choice(("nav", "div")), ("menu", "nav", "navigation", "navbar", "breadcrumb"), lambda: self.links(r.randint(2, 8)))
        elif kind == 1:
            self.wrap(r.choice(("div", "aside", "section")), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"), lambda: self.block(r.choice(("p", "div")), self.prose(r.randint(1, 3)), 0))
        elif kind == 2:
            self.block("div", self.prose(r.randint(1, 2)), 0, f' class="{r.choice(("ad", "ads", "advert", "sponsor", "promo"))}"')
        elif kind == 3:
            self.wrap(r.choice(("aside", "div")), ("sidebar", "related", "widget", "recommended", "") if r.random() < 0.8 else ("sidebar",), lambda: (self.block("h3", self.words(1, 4), 0), self.links(r.randint(2, 6)) if r.random() < 0.6 else self.block("p", self.prose(2), 0)))
        elif kind == 4:
            self.wrap(r.choice(("div", "section")), ("cookie-notice", "consent", "notice", "popup", "newsletter", "alert", "modal"), lambda: self.block("p", self.prose(r.randint(1, 3)), 0))
        elif kind == 5:
            self.wrap("form", ("search", "login", "subscribe", "contact", ""), lambda: self.block("div", f"<label>{self.words(1, 3)}</label> <button>{self.words(1, 2)}</button>", 0) if r.random() < 0.3 else self.block("p", self.words(2, 8), 0))
        elif kind == 6:
            self.block("div", f'<a href="#">{self.words(1, 2)}</a> | <a href="#">{self.words(1, 2)}</a>', 0, f' class="{r.choice(("share", "social", "tags", "meta", "toolbar"))}"')
        elif kind == 7:
            self.wrap("aside", ("",), lambda: self.block("p", self.prose(r.randint(1, 4)), 0))
        elif kind == 8:
            self.block("p", self.words(2, 6), 0, f' class="{r.choice(("copyright", "legal", "disclaimer", "notice"))}"')
        elif kind == 9:
            self.block(r.choice(("aside", "header", "footer", "form")), self.prose(r.randint(1, 3)) if r.random() < 0.7 else self.words(1, 6), 0)
        else:
            self.block("nav", " ".join(f'<a href="/{self.r.randint(1, 99)}">{self.words(1, 3)}</a>' for _ in range(r.randint(2, 7))), 0)

    def comments(self) -> None:
        r = self.r

        def inside():
            self.block("h2", self.words(1, 3), 0)
            for _ in range(r.randint(1, 5)):
                self.wrap(r.choice(("div", "li", "article")), ("comment", "reply", "comment-body", "response"), lambda: (self.block("p", self.prose(r.randint(1, 4)), 0) if r.random() < 0.8 else self.block("div", self.prose(r.randint(1, 4)), 0)))

        self.wrap(r.choice(("section", "div", "ol")), ("comments", "comment-list", "discussion", "responses", "disqus"), inside)

    def article(self) -> None:
        r = self.r
        short = r.random() < 0.25
        if r.random() < 0.8:
            self.block(r.choice(("h1", "h1", "h2")), self.words(1, 3) + "." if short else self.words(3, 10).capitalize(), 1)
        messy = r.random() < 0.5
        if short:
            self.block("p", self.words(1, 9).capitalize() + ".", 1)
        for _ in range(r.randint(0, 1) if short else r.randint(1, 14)):
            kind = r.random()
            if kind < 0.75:
                if messy and r.random() < 0.4:
                    self.html.append("<p><b>" + self.prose(r.randint(1, 5)) + "<br>")  # neither is closed
                    self.labels.append(1)
                else:
                    text = self.prose(r.randint(1, 8)) if r.random() < 0.8 else self.words(1, 5) + "."
                    self.block("p", text if r.random() < 0.7 else f'{text} <a href="/x">{self.words(1, 4)}</a> {self.words(1, 5)}.', 1)
            elif kind < 0.82:
                self.block(r.choice(("h2", "h3")), self.words(1, 6).capitalize(), 1)
            elif kind < 0.88:
                self.html.append("<ul>")
                for _ in range(r.randint(2, 4)):
                    self.block("li", self.words(3, 12), 1)
                self.html.append("</ul>")
            elif kind < 0.91:
                self.part()
            elif kind < 0.93:
                self.html.append("<blockquote>")
                self.block("p", self.prose(2), 1)
                self.html.append("</blockquote>")
            elif kind < 0.95:
                self.block(r.choice(("pre", "div", "td")) if r.random() < 0.5 else "div", self.prose(2), 1)
            else:
                self.noise()

    def part(self) -> None:
        """A table, a figure, a definition list, a part to unfold or a controls that belongs to the article; controls have no text of their own."""
        r = self.r
        kind = r.randrange(6)
        if kind == 0:
            self.html.append("<table>")
            if r.random() < 0.3:
                self.block("caption", self.words(1, 6), 1)
            for row in range(r.randint(1, 5)):
                self.html.append("<tr>")
                for _ in range(r.randint(1, 4)):
                    self.block("th" if not row and r.random() < 0.5 else "td", self.words(1, 8), 1)
                self.html.append("</tr>" * (r.random() < 0.8))
            self.html.append("</table>")
        elif kind == 1:
            self.html.append('<figure><img src="x.png">')
            self.block("figcaption", self.words(1, 12), 1)
            self.html.append("</figure>")
        elif kind == 2:
            self.html.append("<dl>")
            for _ in range(r.randint(1, 4)):
                self.block("dt", self.words(1, 3), 1)
                self.block("dd", self.words(2, 12), 1)
            self.html.append("</dl>")
        elif kind == 3:
            self.html.append("<details>")
            self.block("summary", self.words(1, 5), 1)
            self.block("p", self.prose(r.randint(1, 3)), 1)
            self.html.append("</details>")
        elif kind == 4:
            self.html.append(r.choice(("<section>", "<div>")))
            for _ in range(r.randint(1, 3)):
                self.block("p", self.prose(r.randint(1, 3)), 1)
            self.html.append("</section></div>")
        else:
            self.html.append(r.choice(('<video src="x">', "<select><option>" + self.words(1, 2), "<canvas>" + self.words(1, 2) + "</canvas>", "<object>")))
            self.block("p", self.prose(r.randint(1, 3)), 1)

    def bare(self) -> tuple[str, list[int]]:
        """A page without a frame: a text alone, in few elements or in none; or a frame without a text."""
        r = self.r
        kind = r.randrange(8)
        text = lambda: self.prose(r.randint(1, 5)) if r.random() < 0.6 else self.words(1, 6).capitalize() + r.choice((".", "", "!"))
        if kind == 0:
            return text(), [1]
        if kind == 1:
            tags = r.choice((("", ""), ("<html><body>", "</body></html>"), ("<html><head><title>t</title></head><body>", "</body></html>"), ("<body>", "")))
            lines = r.choice(("<br>", "<br><br>", " ")).join(text() for _ in range(r.randint(1, 4)))
            return tags[0] + lines + tags[1], [1]
        if kind == 2:  # text of the page itself beside its menus
            self.html.append("<html><body>")
            for part in r.choice(((1, 0), (0, 1), (0, 1, 0))):
                if part:
                    self.html.append("<br>".join(self.prose(r.randint(1, 4)) for _ in range(r.randint(1, 4))))
                    self.labels.append(1)
                else:
                    self.noise()
            return "".join(self.html) + "</body></html>", self.labels
        if kind == 3:
            self.html.append("<html><body>")
            for _ in range(r.randint(1, 3)):
                self.noise()
            self.html.append("</body></html>")
            return "".join(self.html), self.labels
        before, after = r.choice((("<html><body>", "</body></html>"), ("<body>", "</body>"), ("", "")))
        inner = r.choice(((), (), ("article",), ("main",), ("div",), ("section",), ("div", "div"), ("main", "article")))
        self.html.append(before + "".join(f"<{x}>" for x in inner))
        if r.random() < 0.3:
            self.block(r.choice(("h1", "h2")), self.words(1, 6).capitalize(), 1)
        for _ in range(r.choice((1, 1, 1, 2, 3))):
            self.part() if r.random() < 0.4 else self.block("p" if r.random() < 0.8 else "div", text(), 1)
        self.html.append("".join(f"</{x}>" for x in reversed(inner)) + after)
        return "".join(self.html), self.labels

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        if r.random() < 0.25:
            return self.bare()
        self.html.append("<html><head><title>t</title></head><body>")
        if r.random() < 0.6:
            self.wrap(r.choice(("header", "div")), ("header", "masthead", "top", "logo"), lambda: (self.block(r.choice(("h1", "p", "div")), self.words(1, 4), 0), r.random() < 0.5 and self.links(r.randint(2, 6))))
        for _ in range(r.randint(0, 3)):
            self.noise()
        wrappers = r.randint(0, 2)
        self.html.append("".join(f'<div {r.choice(("id", "class"))}="{r.choice(("page", "wrapper", "container", "row", "layout"))}">' for _ in range(wrappers)))
        kind = r.random()
        if kind < 0.5:
            self.wrap("article", ("", "", "post", "story", "entry"), self.article)
        elif kind < 0.7:
            self.wrap("main", ("", "content", "main"), self.article)
        elif kind < 0.95:
            self.wrap(r.choice(("div", "section")), ("content", "post-content", "article-body", "entry", "story", "text", "main-content"), self.article)
        else:
            self.article()
        if r.random() < 0.5:
            self.comments()
        for _ in range(r.randint(0, 3)):
            self.noise()
        self.html.append("</div>" * wrappers)
        if r.random() < 0.4:
            self.block("footer", f"&copy; {self.words(1, 4)} &middot; {self.prose(r.randint(1, 3))}" if r.random() < 0.7 else self.words(1, 8), 0)
        elif r.random() < 0.7:
            self.wrap(r.choice(("footer", "footer", "div")), ("footer", "site-footer", "bottom"), lambda: self.block("p", self.prose(1), 0) if r.random() < 0.5 else self.block("div", "&copy; " + self.words(1, 6), 0))
        return "".join(self.html) + ("</body></html>" if r.random() < 0.8 else ""), self.labels


def labelled_pages(n: int) -> list[tuple[str, list[int]]]:
    """n pages, each with the labels of its text blocks in page order."""
    return [Maker(seed).page() for seed in range(n)]
