"""Labelled pages for the extraction model: composed at random from common page parts."""

from __future__ import annotations

import random

# How sites commonly mark the parts of a page.
CONTENT = [
    "<article>", "<article>", "<article>", "<article>", "<article class='post'>", "<main><article>", "<main>", "<main id='content'>", "<div id='content'>", "<div class='content'>", "<div class='post-content'>",
    "<div class='entry-content'>", "<section class='article-body'>", "<div class='story'>", "<div itemprop='articleBody' class='text'>", "<div class='main'><div class='body'>", "<div role='main'>", "<div>", "<div class='{x}'>", "<section>", "<article class='{x}'>", "<article><div class='{x}'>", "",
]
PARTS = {
    "header": ["<header>", "<div id='header'>", "<div class='site-header'>", "<div class='masthead'>", "<header class='top'>", "<div class='banner' role='banner'>", "<div class='top-bar'>"],
    "nav": ["<nav>", "<nav class='menu'>", "<div class='navbar'>", "<div id='menu'>", "<div class='navigation'>", "<ul class='nav'>", "<ul class='menu'>", "<div class='breadcrumb'>", "<ol class='breadcrumbs'>", "<div class='pagination'>", "<div role='navigation'>", "<nav class='{x}'>"],
    "notice": ["<div class='cookie-notice'>", "<div id='consent'>", "<div class='cookie-banner'>", "<div class='notice'>", "<div role='alert'>", "<div class='alert'>", "<div class='popup'>", "<div class='modal'>", "<div class='gdpr'>", "<section class='notice'>", "<p class='notice'>", "<aside class='notice'>", "<div class='disclaimer'>"],
    "ad": ["<div class='ad'>", "<div class='ads'>", "<div class='advert'>", "<div class='advertisement'>", "<aside class='sponsored'>", "<div class='ad-banner'>", "<div id='ad-top'>", "<div class='promo'>", "<ins class='adsbygoogle'>", "<section class='ad'>", "<p class='ad'>", "<aside class='ad'>"],
    "sidebar": ["<aside>", "<div class='sidebar'>", "<div id='sidebar'>", "<aside class='sidebar'>", "<div class='widget'>", "<div id='secondary' class='widget-area'>", "<div class='related'>", "<aside class='related-posts'>", "<div class='recommended'>", "<section class='related'>", "<aside class='{x}'>"],
    "share": ["<div class='share'>", "<ul class='social'>", "<div class='share-buttons'>", "<div class='tags'>", "<div class='follow-us'>"],
    "form": ["<form>", "<form class='search'>", "<div class='newsletter'><form>", "<form id='login'>", "<div class='subscribe'><form>", "<form action='/s'>"],
    "comments": ["<div class='comments'>", "<section id='comments'>", "<section class='comments'>", "<div id='disqus_thread' class='comments'>", "<ol class='comment-list'>", "<div class='comment'>", "<div class='user-comments'>", "<div class='responses'>", "<div class='reader-comments'>", "<article class='comment'>", "<div class='discussion'>"],
    "footer": ["<footer>", "<div id='footer'>", "<div class='footer'>", "<div class='site-footer'>", "<footer class='{x}'>", "<div role='contentinfo'>", "<div class='copyright'>"],
}


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[tuple[str, int | None]] = []

    def word(self) -> str:
        return "".join(self.r.choice(["ka", "lo", "mi", "re", "tu", "so", "an", "er", "is", "ben", "dar", "éc", "ü", "ñi"]) for _ in range(self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def prose(self) -> str:
        r, out = self.r, []
        for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8])):
            s = self.words(1, 22).split()
            s = [w + "," if r.random() < 0.08 else w for w in s]
            if r.random() < 0.1:
                s.insert(r.randrange(len(s) + 1), f"<a href='/{self.word()}'>{self.words(1, 3)}</a>")
            if r.random() < 0.1:
                s.insert(r.randrange(len(s) + 1), f"<b>{self.word()}</b>")
            junk = r.choice(["", "", "", "", "", "", "%%%", "!!", "***"])
            out.append((junk + " ").join(s).capitalize() + r.choice([".", ".", ".", ".", "!", "?", ""]) + junk)
        return r.choice([" ", " ", " ", "<br>", "\n"]).join(out)

    def raw(self, markup: str) -> None:
        self.out.append((markup, None))

    def block(self, tag: str, text: str, label: int) -> None:
        if tag:
            self.raw(f"<{tag}>")
        self.out.append((text, label))
        if tag and not (tag == "p" and self.r.random() < 0.15):
            self.raw(f"</{tag}>")

    def links(self, label: int) -> None:
        self.raw("<ul>" if self.r.random() < 0.8 else "<div>")
        for _ in range(self.r.randint(1, 8)):
            self.block(self.r.choice(["li", "li", "li", "div", "span"]), f"<a href='/{self.word()}'>{self.words(1, 4)}</a>", label)
            self.raw("</div><div>" if self.r.random() < 0.02 else "\n")
        self.raw("</ul>")

    def part(self, kind: str) -> None:
        r = self.r
        opened = r.choice(PARTS[kind]).replace("{x}", self.word())
        self.raw(opened)
        if kind in ("nav", "share"):
            self.links(0)
        elif kind in ("ad", "notice"):
            for _ in range(r.choice([1, 1, 2])):
                self.block(r.choice(["p", "", "div", "span"]), self.prose() if r.random() < 0.8 else f"<a href='#'>{self.words(1, 4)}</a>", 0)
                self.raw("<hr>")
        elif kind == "form":
            self.block(r.choice(["label", "p", "div", "h3"]), self.words(1, 6), 0)
            self.raw("<input><hr>")
            self.block(r.choice(["button", "p", "span"]), self.prose() if r.random() < 0.3 else self.words(1, 3), 0)
        elif kind == "comments":
            if r.random() < 0.7:
                self.block(r.choice(["h2", "h3"]), self.words(1, 3), 0)
            for _ in range(r.randint(1, 6)):
                self.raw(r.choice(["<div class='comment'>", "<li>", "<div>", "<article>", "<div class='{x}'>"]).replace("{x}", self.word()))
                if r.random() < 0.6:
                    self.block(r.choice(["span", "b", "div", "cite"]), self.words(1, 2), 0)
                    self.raw("<hr>")
                for _ in range(r.choice([1, 1, 2])):
                    self.block(r.choice(["p", "p", "div"]), self.prose(), 0)
                self.raw("</div></li></article>" if "article" not in opened else "</div>")
        else:
            for _ in range(r.randint(1, 4)):
                x = r.random()
                if x < 0.35:
                    self.links(0)
                elif x < 0.5:
                    self.block(r.choice(["h1", "h2", "h3", "div", "p"]), self.words(1, 4), 0)
                elif x < 0.65 and kind == "footer":
                    self.block(r.choice(["p", "div", "small"]), f"&copy; {self.word()}.com &middot; {self.prose()}", 0)
                    self.raw("<hr>")
                else:
                    self.block(r.choice(["p", "p", "div"]), self.prose(), 0)
        self.raw(_ends(opened))

    def article(self) -> None:
        r = self.r
        opened = r.choice(CONTENT).replace("{x}", self.word())
        self.raw(opened)
        if r.random() < 0.85:
            inside = r.random() < 0.2
            self.raw("<header>" if inside else "")
            self.block("h1", self.words(1, 14) + r.choice(["", "", ".", "?"]), 1)
            self.raw("</header>" if inside else "")
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14, 20])):
            x = r.random()
            if x < 0.75:
                self.block(r.choice(["p"] * 8 + ["div"]), self.prose(), 1)
            elif x < 0.82:
                self.block(r.choice(["h2", "h3", "h4"]), self.words(1, 6), 1)
            elif x < 0.87:
                self.raw(r.choice(["<ul>", "<ol>"]))
                for _ in range(r.randint(1, 5)):
                    self.block("li", self.prose() if r.random() < 0.6 else self.words(1, 6), 1)
                self.raw("</ul></ol>")
            elif x < 0.9:
                self.block(r.choice(["blockquote", "pre", "figcaption"]), self.prose(), 1)
            elif x < 0.92:
                self.raw("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    self.block("td", self.words(1, 5), 1)
                self.raw("</tr></table>")
            elif x < 0.96:
                self.raw(f"<p><b>{self.words(1, 2)}" if r.random() < 0.2 else "<hr>")
                if self.out[-1][0] != "<hr>":
                    self.out[-1] = ("<p><b>", None)
                    self.out.append((self.prose() + "<br>", 1))
            else:
                self.part(r.choice(["ad", "sidebar", "share", "form", "notice"]))
        if r.random() < 0.15:
            self.part("comments")
        self.raw(_ends(opened))

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        r = self.r
        self.out = []
        self.raw("<!DOCTYPE html><html><head><title>x</title><script>var a = '<p>x</p>';</script></head><body>")
        for kind, p in (("notice", 0.25), ("header", 0.5), ("nav", 0.8), ("ad", 0.4), ("sidebar", 0.15), ("form", 0.1)):
            if r.random() < p:
                self.part(kind)
        self.article()
        for kind, p in (("ad", 0.2), ("share", 0.2), ("comments", 0.35), ("sidebar", 0.4), ("form", 0.2), ("notice", 0.1), ("nav", 0.15), ("footer", 0.8)):
            if r.random() < p:
                self.part(kind)
        return self.out


def _ends(opened: str) -> str:
    import re

    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))


def labelled_pages(n: int = 900, seed: int = 11) -> list[list[tuple[str, int | None]]]:
    """Pages as pieces of markup: (text, 1) in the article, (text, 0) elsewhere, (markup, None) between."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
