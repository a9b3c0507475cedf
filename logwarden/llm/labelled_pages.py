"""Labelled pages on which the extraction of main text is trained.

Pages are composed by rule from layouts, names of regions and invented sentences. The
attribute ``data-main`` marks the article, ``data-other`` what is inside it without being
part of it. Nothing but the labels reads these attributes.
"""

from __future__ import annotations

from random import Random

#: Names that sites give to regions that are not the article.
MENU = "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs pagination toc tabs".split()
HEADER = "header masthead site-header top topbar branding banner logo hero-bar".split()
FOOTER = "footer site-footer bottom copyright colophon legal foot".split()
SIDE = "sidebar aside widget related recommended popular trending more-stories rail secondary".split()
NOTICE = "cookie cookie-notice notice consent gdpr alert popup modal overlay disclaimer message".split()
ADVERT = "ad ads advert advertisement sponsor sponsored promo promotion banner-ad ad-slot adsense".split()
FORM = "form search search-form newsletter subscribe signup login contact-form".split()
COMMENTS = "comments comment comment-list respond replies discussion disqus reader-comments".split()
SHARE = "share social sharing tools meta byline tags author-box post-meta".split()
#: Names of the article and of what is around it.
ARTICLE = "article post content entry-content post-content article-body story main-content entry body-text".split()
WRAP = "container wrapper page site row col layout inner main outer grid".split()

SYLLABLES = "ka lo mi ren ta su vel or na dis pe tum ar ing qui es ba no ter li ma ço é ün ße ло на ти".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        words = self.words(1 if self.r.random() < 0.1 else 4, 18).split(" ")
        marked = [w + ("," if self.r.random() < 0.12 else "") for w in words[:-1]] + words[-1:]
        return " ".join(marked).capitalize() + self.r.choice("....!?")

    def prose(self, high: int = 7) -> str:
        if self.r.random() < 0.15:
            return self.junk()
        out = [self.sentence() for _ in range(1 if self.r.random() < 0.2 else self.r.randint(1, high))]
        text = " ".join(out)
        kind = self.r.random()
        if kind < 0.1:
            return f"<b>{text}</b>"
        if kind < 0.2:
            return f"{text} <a href='/{self.word()}'>{self.words(1, 4)}</a> {self.sentence()}"
        if kind < 0.3:
            return f"<b>{text}<br>"
        return text.replace(" ", " &amp; ", 1) if kind < 0.35 else text

    def junk(self) -> str:
        """What articles hold beside sentences: repeated words, figures, lines of code, rights, addresses."""
        word, kind = self.word(), self.r.randint(0, 6)
        if kind == 0:
            return " ".join([word] * self.r.randint(2, 60))
        if kind == 1:
            return self.words(1, 30)
        if kind == 2:
            return " ".join(str(self.r.randint(0, 10**6)) for _ in range(self.r.randint(2, 30)))
        if kind == 3:
            return f"&copy; {self.r.randint(1990, 2030)} {self.words(1, 6)} {self.sentence()}"
        if kind == 4:
            return f"{word}@{self.word()}.example +{self.r.randint(10**9, 10**10)} {self.words(0, 4)}"
        if kind == 5:
            return f"{word} = {self.word()}({self.r.randint(0, 99)}); // {self.words(1, 5)}"
        return self.words(1, 5).upper() + " " + "!?#*|"[self.r.randint(0, 4)] * self.r.randint(1, 9)

    def named(self, names: list[str]) -> str:
        kind, name = self.r.random(), self.r.choice(names)
        if kind < 0.6:
            return f' class="{name}"'
        if kind < 0.8:
            return f' id="{name}"'
        return f' class="{name} {self.word()}-{self.r.randint(1, 9)}"' if kind < 0.93 else ""

    def links(self) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(3, 9))]
        kind = self.r.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items) if kind < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def menu(self) -> str:
        return f"<nav{self.named(MENU) if self.r.random() < 0.5 else ''}>{self.links()}</nav>" if self.r.random() < 0.6 else f"<div{self.forced(MENU)}>{self.links()}</div>"

    def forced(self, names: list[str]) -> str:
        return self.named(names) or f' class="{self.r.choice(names)}"'

    def heading(self) -> str:
        level = self.r.randint(1, 4)
        return f"<h{level}>{self.words(1, 5)}</h{level}>" if self.r.random() < 0.35 else ""

    def header(self) -> str:
        inner = self.heading() + f"<a href='/'>{self.words(1, 3)}</a>" + (f"<p>{self.words(2, 8)}</p>" if self.r.random() < 0.4 else "") + (self.menu() if self.r.random() < 0.4 else "")
        return f"<header{self.named(HEADER)}>{inner}</header>" if self.r.random() < 0.5 else f"<div{self.forced(HEADER)}>{inner}</div>"

    def footer(self) -> str:
        inner = f"&copy; {self.word()}.example &middot; {self.sentence()} {self.sentence()}" if self.r.random() < 0.6 else f"<p>&copy; {self.r.randint(1999, 2030)} {self.words(2, 6)}</p>{self.links()}"
        return f"<footer{self.named(FOOTER)}>{inner}</footer>" if self.r.random() < 0.6 else f"<div{self.forced(FOOTER)}>{inner}</div>"

    def box(self, names: list[str], inner: str, tag: str = "div") -> str:
        return f"<{tag}{self.forced(names)}>{inner}</{tag}>"

    def advert(self) -> str:
        inner = self.r.choice([self.sentence(), self.prose(2), f"<a href='/{self.word()}'>{self.sentence()}</a>", f"<p>{self.prose(3)}</p>"])
        return self.box(ADVERT, self.heading() + inner, self.r.choice(["div", "div", "aside", "section"]))

    def notice(self) -> str:
        return self.box(NOTICE, self.heading() + f"<p>{self.sentence()} {self.sentence()}</p><button>{self.word()}</button>" if self.r.random() < 0.5 else self.sentence())

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 4)}</h3>" + (self.links() if self.r.random() < 0.6 else "".join(f"<p>{self.prose(2)}</p>" for _ in range(self.r.randint(1, 3))))
        return f"<aside{self.named(SIDE)}>{inner}</aside>" if self.r.random() < 0.5 else self.box(SIDE, inner)

    def form(self) -> str:
        inner = self.heading() + f"<label>{self.words(1, 3)}</label><input name='{self.word()}'><p>{self.sentence()}</p><button>{self.word()}</button>"
        return f"<form{self.named(FORM)}>{inner}</form>" if self.r.random() < 0.7 else self.box(FORM, f"<form>{inner}</form>")

    def comments(self) -> str:
        one = lambda: f"<div{self.named(['comment', 'reply', 'comment-body'])}><b>{self.word()}</b><p>{self.prose(4)}</p></div>"
        inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(self.r.choice([1, 2, 3, 5, 25]))) + (self.form() if self.r.random() < 0.4 else "")
        return self.box(COMMENTS, inner, self.r.choice(["div", "section"]))

    def share(self) -> str:
        return self.box(SHARE, self.r.choice([self.links(), self.words(2, 6)]))

    def article(self) -> str:
        parts = [f"<h1>{self.sentence()}</h1>"] if self.r.random() < 0.85 else []
        for _ in range(self.r.choice([1, 2, 3, 5, 8, 14, 14, 30, 80])):
            kind = self.r.random()
            if kind < 0.78:
                parts.append(f"<p>{self.prose()}" + ("</p>" if self.r.random() < 0.9 else ""))
            elif kind < 0.84:
                parts.append(f"<h{(n := self.r.randint(2, 4))}>{self.words(1, 6)}</h{n}>")
            elif kind < 0.90:
                parts.append("<ul>" + "".join(f"<li>{self.sentence()}" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote><p>{self.prose(2)}</p></blockquote>")
            elif kind < 0.97:
                parts.append("<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.words(1, 5)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(f"<div>{self.prose()}</div>")
        if self.r.random() < 0.45:
            other = self.r.choice([self.advert, self.share, self.side, self.form, self.notice])()
            at = self.r.randint(0, len(parts))
            parts.insert(at, other.replace(">", " data-other>", 1))
        inner = "".join(parts)
        kind = self.r.random()
        if kind < 0.5:
            body = f"<article data-main{self.named(ARTICLE) if self.r.random() < 0.4 else ''}>{inner}</article>"
            return f"<main>{body}</main>" if self.r.random() < 0.3 else body
        if kind < 0.6:
            return f"<main data-main>{inner}</main>"
        return f"<{(t := self.r.choice(['div', 'div', 'section', 'td']))} data-main{self.forced(ARTICLE)}>{inner}</{t}>"

    def page(self) -> str:
        before = [f() for f in (self.header, self.menu, self.notice, self.advert, self.form, self.side) if self.r.random() < 0.45]
        after = [f() for f in (self.comments, self.side, self.advert, self.share, self.footer, self.notice, self.form) if self.r.random() < 0.45]
        self.r.shuffle(before)
        middle = self.article() if self.r.random() < 0.96 else ""
        inner = "".join(before) + middle + "".join(after)
        for _ in range(self.r.choice([0, 0, 1, 2])):
            inner = f"<div{self.named(WRAP)}>{inner}</div>"
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{inner}" + ("</body></html>" if self.r.random() < 0.9 else "")


def pages(count: int = 400, seed: int = 7) -> list[str]:
    """``count`` labelled pages; the same for the same seed."""
    return [_Writer(seed * 100_003 + k).page() for k in range(count)]
