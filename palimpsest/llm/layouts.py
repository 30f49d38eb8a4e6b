"""Generated web pages with known main text, to train the block labeller on.

A page is drawn from a seeded generator: a header, menus, side columns, an
article in one of many wrappings, and things that stand around or inside it:
adverts, notices, forms, sharing and related links, reader comments, a footer.
Words are made of syllables, so that no language is learnt; the cues that real
pages give (names of elements, classes and ids, words such as "copyright") are
listed below. Some pages have no names at all, so that structure must do, and
some leave elements open or are cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SYLLABLES = "an ber ca de el fi gor ha in jo ka lu men no or pa qui ra ste ti un ver wo xe yl zu ch ion ent ou ai é ü ñ ß ing th".split()
ARTICLE = "content post entry story article-body main-content post-body text body-text entry-content page-content article__body".split()
SIDE = "sidebar widget related rail aside side-column recommended popular trending tags".split()
ADVERT = "ad ads advert advertisement sponsored promo banner ad-slot adbox sponsor commercial".split()
NOTICE = "notice cookie cookie-banner alert gdpr consent message announcement paywall warning privacy-notice popup modal".split()
COMMENT = "comments comment-list comment responses discussion replies disqus".split()
MENU = "menu navbar nav navigation topnav main-menu breadcrumb breadcrumbs pagination pager tabs".split()
SHARE = "share social social-links sharing toolbar byline meta post-meta author tools".split()
FOOT = "footer site-footer bottom copyright colophon legal".split()
NOTICE_WORDS = "we use cookies accept subscribe newsletter sign up privacy policy terms agree consent log in to continue".split()
FOOT_WORDS = "© copyright all rights reserved privacy terms contact imprint".split()
FORM_WORDS = "search email password name submit send subscribe your message login comment reply".split()


class Pages:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def word(self) -> str:
        return "".join(self.pick(SYLLABLES) for _ in range(int(self.rng.integers(1, 4))))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(lo, hi))))

    def sentence(self, lo: int = 4, hi: int = 18) -> str:
        text = self.words(lo, hi)
        return text[0].upper() + text[1:] + self.pick([".", ".", ".", "!", "?", ""])

    def odd(self) -> str:
        """Text of unusual looks, which an article may hold as well: cells in a line, capitals, signs, one word over and over, very short."""
        words = self.words(3, 40).split(" ")
        roll = int(self.rng.integers(5))
        if roll == 0:
            return " | ".join(words) + "."
        if roll == 1:
            return "!! ".join(words).upper() + "."
        if roll == 2:
            sign = self.pick(["***", "%%%", "###", "$$$", "++", "~"])
            return " ".join(w + sign for w in words)
        if roll == 3:
            return " ".join([words[0]] * len(words))
        return self.label(1, 3)

    def prose(self, most: int = 5) -> str:
        if self.strange and self.chance(0.6):
            return self.odd()
        return " ".join(self.sentence() for _ in range(int(self.rng.integers(1, most + 1))))

    def named(self, tag: str, names: list[str], inner: str) -> str:
        if self.bare:
            return f"<{tag}>{inner}</{tag}>"
        name = self.pick(names)
        kind = self.pick(["class", "class", "id"])
        extra = f" {self.word()}" if kind == "class" and self.chance(0.3) else ""
        return f'<{tag} {kind}="{name}{extra}">{inner}</{tag}>'

    def label(self, lo: int, hi: int) -> str:
        """A few words as they stand on a link or a heading, now and then with a stop."""
        text = self.words(lo, hi)
        if self.chance(0.4):
            text = text[0].upper() + text[1:]
        return text + self.pick(["", "", "", ".", ",", "!", "?", ":"])

    def links(self, lo: int = 2, hi: int = 9, tag: str = "li") -> str:
        items = "".join(f'<li><a href="/{self.word()}">{self.label(1, 4)}</a></li>' for _ in range(int(self.rng.integers(lo, hi))))
        if tag == "li":
            return f"<ul>{items}</ul>"
        return " ".join(f'<a href="/{self.word()}">{self.label(1, 3)}</a>' for _ in range(int(self.rng.integers(lo, hi))))

    def menu(self) -> str:
        inner = self.links() if self.chance(0.8) else self.links(tag="a")
        return f"<nav>{inner}</nav>" if self.chance(0.6) else self.named("div", MENU, inner)

    def advert(self) -> str:
        inner = self.pick([self.sentence(), f"<p>{self.prose(2)}</p>", f'<a href="/x">{self.sentence()}</a>'])
        return self.named(self.pick(["div", "div", "aside", "section"]), ADVERT, inner)

    def notice(self) -> str:
        text = " ".join(self.pick(NOTICE_WORDS) if self.chance(0.4) else self.word() for _ in range(int(self.rng.integers(4, 25))))
        return self.named(self.pick(["div", "section", "p"]), NOTICE, text if self.chance(0.5) else f"<p>{text}</p><button>{self.word()}</button>")

    def form(self) -> str:
        fields = "".join(f"<label>{self.pick(FORM_WORDS)}</label><input name=x>" for _ in range(int(self.rng.integers(1, 4))))
        return f"<form><p>{self.pick(FORM_WORDS)} {self.words(1, 8)}</p>{fields}<button>{self.pick(FORM_WORDS)}</button></form>"

    def side(self) -> str:
        inner = f"<h3>{self.label(1, 4)}</h3>" + self.pick([self.links(), f"<p>{self.prose(2)}</p>", self.links() + f"<p>{self.sentence()}</p>"])
        return f"<aside>{inner}</aside>" if self.chance(0.5) else self.named("div", SIDE, inner)

    def comments(self) -> str:
        one = lambda: self.pick([f"<p>{self.prose(3)}</p>", f"<span>{self.word()}</span><p>{self.prose(2)}</p>", self.prose(2)])
        tag = self.pick(["li", "div", "article", "section"])
        body = "".join(self.named(tag, ["comment", "reply", "comment-body"], one()) for _ in range(int(self.rng.integers(1, 6))))
        head = f"<h3>{self.label(1, 3)}</h3>" if self.chance(0.6) else ""
        bare, self.bare = self.bare, False  # nothing but its name tells a comment
        out = self.named(self.pick(["div", "section", "ol"]), COMMENT, head + body)
        self.bare = bare
        return out

    def share(self) -> str:
        return self.named("div", SHARE, self.links(1, 5, "a"))

    def footer(self) -> str:
        text = " ".join(self.pick(FOOT_WORDS) if self.chance(0.4) else self.word() for _ in range(int(self.rng.integers(3, 14))))
        if self.chance(0.5):
            text = f"&copy; {self.word()}.example &middot; {self.prose(3)}"
        inner = self.pick([text, f"<p>{text}</p>", text + self.links()])
        return f"<footer>{inner}</footer>" if self.chance(0.7) else self.named("div", FOOT, inner)

    def article(self) -> tuple[str, list[str]]:
        """Markup and the texts of its main blocks."""
        out, main = [], []

        def add(tag: str, text: str) -> None:
            shown = text
            if self.chance(0.25):
                words = text.split(" ")
                i = int(self.rng.integers(len(words)))
                words[i] = f'<{(t := self.pick(["b", "em", "span", "i"]))}>{words[i]}</{t}>' if self.chance(0.6) else f'<a href="/y">{words[i]}</a>'
                shown = " ".join(words)
            roll = self.rng.random()
            if tag == "p" and roll < 0.12:
                out.append(f"<p><b>{text}<br>")
            elif tag == "p" and roll < 0.25:
                out.append(f"<p>{shown}")
            else:
                out.append(f"<{tag}>{shown}</{tag}>")
            main.append(text)

        title = self.words(2, 10)
        if self.chance(0.85):
            add(self.pick(["h1", "h1", "h2"]), title)
        for k in range(int(self.rng.integers(1, 12)) if self.chance(0.9) else int(self.rng.integers(12, 60))):
            roll = self.rng.random()
            if roll < 0.70:
                add("p", self.prose(6) if self.chance(0.8) else self.sentence(1, 4))
            elif roll < 0.78:
                add(self.pick(["h2", "h3"]), self.words(1, 6))
            elif roll < 0.84:
                items = [self.sentence(2, 10) for _ in range(int(self.rng.integers(2, 6)))]
                tag = self.pick(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{t}</li>" for t in items) + f"</{tag}>")
                main += items
            elif roll < 0.88:
                add("blockquote", self.prose(2))
            elif roll < 0.90:
                add("pre", self.words(3, 12))
            elif roll < 0.93:
                cells = [self.words(1, 4) for _ in range(4)]
                out.append("<table><tr><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></table>".format(*cells))
                main += cells
            elif self.chance(0.8):
                out.append(self.pick([self.advert, self.share, self.side, self.notice, self.form])())
        if self.chance(0.15):
            out.append(self.pick([self.share, self.comments, self.side])())
        body = "".join(out)
        roll = self.rng.random()
        if roll < 0.5:
            body = f"<article>{body}</article>"
        elif roll < 0.65:
            body = f"<main>{body}</main>"
        elif roll < 0.92 and not self.bare:
            body = self.named(self.pick(["div", "div", "section"]), ARTICLE, body)
        else:
            body = f"<div>{body}</div>"
        return body, main

    def page(self) -> tuple[str, frozenset[str]]:
        self.bare = self.chance(0.12)
        self.strange = self.chance(0.25)
        body, main = self.article()
        self.strange = self.chance(0.05)
        top, end = [], []
        if self.chance(0.3):
            top.append(f"<header><p>{self.words(1, 5)}</p>{self.menu() if self.chance(0.5) else ''}</header>")
        for part, p in ((self.menu, 0.8), (self.notice, 0.2), (self.advert, 0.45), (self.side, 0.2), (self.form, 0.15)):
            if self.chance(p):
                top.append(part())
        for part, p in ((self.share, 0.15), (self.comments, 0.25), (self.side, 0.3), (self.advert, 0.3), (self.form, 0.2), (self.notice, 0.1), (self.menu, 0.1)):
            if self.chance(p):
                end.append(part())
        self.rng.shuffle(end)
        if self.chance(0.85):
            end.append(self.footer())
        inner = "".join(top) + body + "".join(end)
        if self.chance(0.3):
            inner = f'<div class="{self.pick(["wrapper", "container", "page", "site"])}">{inner}</div>'
        close = "</body></html>" if self.chance(0.9) else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title></head><body>{inner}{close}", frozenset(" ".join(t.split()) for t in main)


def generate_pages(count: int, seed: int) -> Iterator[tuple[str, frozenset[str]]]:
    """Pages, each with the texts of its main blocks."""
    maker = Pages(seed)
    for _ in range(count):
        yield maker.page()
