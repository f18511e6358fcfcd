"""Pages with known main text, in many layouts, for fitting the classifier of nodes.

Elements carry ``_y="1"`` or ``_y="0"``, which says whether what is below them is main text;
the parser keeps it as a label and no feature reads it.
"""

from __future__ import annotations

import random

_SYLLABLES = "ar be con da el fo gi ha in jo ka lu me no or pa qui re sa ti un ve wo ex yo za the ing ion ed".split()


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def chance(self, share: float) -> bool:
        return self.r.random() < share

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        text = self.words(low, high).capitalize()
        if self.chance(0.3):
            text = text.replace(" ", ", ", 1)
        return text + self.r.choice("....?!")

    def prose(self, low: int = 1, high: int = 6) -> str:
        if self.chance(0.08):
            return " ".join(w + self.r.choice(("***", "###", "%%%", "&amp;&amp;", " |")) for w in self.words(5, 60).split())
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def inline(self, text: str) -> str:
        words = text.split()
        for _ in range(self.r.choice((0, 0, 0, 1, 2))):
            k = self.r.randrange(len(words))
            tag = self.r.choice(('b', 'i', 'em', 'strong', 'a href="/x"', "span", "code"))
            words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
        return " ".join(words)

    def links(self, low: int = 3, high: int = 9, words: tuple = (1, 3), separator: str = "") -> str:
        return separator.join(f'<a href="/{self.word()}">{self.words(*words)}</a>' for _ in range(self.r.randint(low, high)))

    def listed(self, low: int = 3, high: int = 9, words: tuple = (1, 3), css: str = "") -> str:
        items = [f'<li><a href="/{self.word()}">{self.words(*words)}</a>' + ("</li>" if self.chance(0.9) else "") for _ in range(self.r.randint(low, high))]
        return f"<ul{css}>{''.join(items)}</ul>"

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def css(self, *names: str) -> str:
        name = self.r.choice(names)
        return f' {self.r.choice(("class", "class", "id"))}="{name}"' if name else ""

    # What is not main text.

    def menu(self) -> str:
        tag = self.pick("nav", "nav", "div", "div")
        css = self.css("nav", "menu", "main-menu", "navbar", "topnav") if tag == "div" else self.css("", "", "primary", "site-nav")
        inner = self.listed(3, 12) if self.chance(0.7) else self.links(3, 12, separator=self.pick(" | ", " ", ""))
        return f'<{tag}{css} _y="0">{inner}</{tag}>'

    def head(self) -> str:
        tag = self.pick("header", "div")
        css = self.css("header", "masthead", "site-header", "top") if tag == "div" else self.css("", "site-header")
        inner = self.pick(f"<h1><a href='/'>{self.words(1, 3)}</a></h1>", f'<div class="logo">{self.words(1, 3)}</div>', f"<p>{self.words(2, 6)}</p>")
        return f'<{tag}{css} _y="0">{inner}{self.menu() if self.chance(0.5) else ""}{self.search() if self.chance(0.3) else ""}</{tag}>'

    def search(self) -> str:
        return f'<form action="/s" _y="0">{self.words(1, 3)}<input name="q"><button>{self.words(1, 2)}</button></form>'

    def foot(self) -> str:
        tag = self.pick("footer", "footer", "div")
        css = self.css("footer", "site-footer", "bottom") if tag == "div" else ""
        inner = self.pick(
            f"&copy; {self.word()}.example.com &middot; {self.sentence(2, 9)}", f"<p>&copy; {self.r.randint(1990, 2030)} {self.words(1, 4)}. {self.sentence()}</p>",
            self.links(3, 10, separator=" | "), self.listed(4, 12) + f"<p>{self.sentence()}</p>", self.prose(1, 3),
        )
        return f'<{tag}{css} _y="0">{inner}</{tag}>'

    def advert(self) -> str:
        css = self.css("ad", "ads", "advert", "sponsored", "promo", "banner", "ad-slot", "adsbygoogle")
        tag = self.pick("div", "div", "section", "aside", "p")
        inner = self.pick(self.sentence(2, 12), self.prose(1, 2), f'<a href="/buy">{self.words(2, 7)}</a>', f"<span>{self.words(1, 2)}</span> {self.sentence(2, 9)}")
        return f'<{tag}{css} _y="0">{inner}</{tag}>'

    def notice(self) -> str:
        css = self.css("cookie-notice", "cookie-banner", "consent", "notice", "alert", "popup", "gdpr", "modal", "newsletter", "subscribe-box", "paywall")
        tag = self.pick("div", "div", "section", "p")
        inner = self.pick(self.prose(1, 3), f"<p>{self.prose(1, 3)}</p><button>{self.words(1, 2)}</button>", f"{self.sentence()} <a href='/p'>{self.words(1, 2)}</a>")
        return f'<{tag}{css} _y="0">{inner}</{tag}>'

    def side(self) -> str:
        tag = self.pick("aside", "aside", "div")
        css = self.css("sidebar", "side", "rail", "widget-area", "related") if tag == "div" else self.css("", "sidebar")
        blocks = [self.pick(f"<h3>{self.words(1, 3)}</h3>{self.listed(3, 8, (2, 8))}", f"<h4>{self.words(1, 3)}</h4><p>{self.prose(1, 2)}</p>", f"<div class=widget>{self.links(2, 6, (2, 6), '<br>')}</div>", f"<p>{self.prose(1, 3)}</p>") for _ in range(self.r.randint(1, 3))]
        return f'<{tag}{css} _y="0">{"".join(blocks)}</{tag}>'

    def related(self) -> str:
        return f'<div{self.css("related", "related-posts", "recommended", "more", "read-more", "tags")} _y="0"><h3>{self.words(1, 3)}</h3>{self.listed(2, 7, (2, 8))}</div>'

    def share(self) -> str:
        return f'<div{self.css("share", "social", "share-buttons", "follow")} _y="0">{self.links(2, 5, (1, 2), " ")}</div>'

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name=x>" for _ in range(self.r.randint(1, 4)))
        return f'<form{self.css("", "", "contact", "login", "signup")} _y="0"><p>{self.sentence()}</p>{fields}<button>{self.words(1, 2)}</button></form>'

    def talk(self) -> str:
        one = self.pick("div", "li", "article", "p")
        made = [f'<{one}{self.css("comment", "comment", "reply", "")}>{f"<b>{self.word()}</b> " if self.chance(0.6) else ""}{self.pick("<p>%s</p>" if one != "p" else "%s", "%s") % self.prose(1, 4)}</{one}>' for _ in range(self.r.randint(1, 8))]
        tag = self.pick("section", "div", "ol" if one == "li" else "div")
        return f'<{tag}{self.css("comments", "comment-list", "discussion", "disqus_thread", "responses")} _y="0"><h3>{self.words(1, 3)}</h3>{"".join(made)}{self.form() if self.chance(0.4) else ""}</{tag}>'

    # Main text.

    def block(self) -> str:
        kind = self.r.random()
        if kind < 0.72:
            return f"<p>{self.inline(self.prose())}" + ("</p>" if self.chance(0.85) else "")
        if kind < 0.78:
            return f"<h2>{self.words(1, 7)}</h2>"
        if kind < 0.83:
            return f"<p><b>{self.prose(1, 2)}<br>"
        if kind < 0.88:
            tag = self.pick("ul", "ol")
            return f"<{tag}>" + "".join(f"<li>{self.inline(self.sentence(2, 20))}</li>" for _ in range(self.r.randint(2, 7))) + f"</{tag}>"
        if kind < 0.91:
            return f"<blockquote>{self.pick('<p>%s</p>', '%s') % self.prose(1, 3)}</blockquote>"
        if kind < 0.94:
            rows = "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 4)))
            return f"<table>{rows}</table>"
        if kind < 0.97:
            return f"<figure><img src=x.png><figcaption>{self.sentence()}</figcaption></figure>"
        return f"<pre>{self.words(4, 20)}</pre>"

    def story(self) -> str:
        style = self.r.random()
        count = self.pick("1", "2", "4", "7", "12", "25")
        if style < 0.85:
            blocks = [self.block() for _ in range(int(count))]
        elif style < 0.93:
            blocks = [f"<div>{self.inline(self.prose())}</div>" for _ in range(int(count))]
        else:
            blocks = ["<br><br>".join(self.prose() for _ in range(int(count)))]
        for other, share in ((self.advert, 0.25), (self.share, 0.15), (self.related, 0.12), (self.notice, 0.1), (self.form, 0.06), (self.talk, 0.06), (self.side, 0.05)):
            if self.chance(share):
                blocks.insert(self.r.randint(0, len(blocks)), other())
        title = f"<h1>{self.words(1, 9)}</h1>" if self.chance(0.8) else ""
        return title + "".join(blocks)

    def page(self) -> str:
        tag, css = self.r.choice((
            ("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="content"'),
            ("div", ' class="entry-content"'), ("div", ' class="article-body"'), ("section", ' class="story"'), ("div", ' id="main"'), ("div", ""), ("td", ' class="text"'),
        ))
        body = f'<{tag}{css} _y="1">{self.story()}</{tag}>'
        if tag == "td":
            body = f"<table><tr>{f'<td _y=0>{self.listed()}</td>' if self.chance(0.6) else ''}{body}</tr></table>"
        elif self.chance(0.25):
            body = f"<main>{body}{self.talk() if self.chance(0.3) else ''}</main>"
        elif self.chance(0.3):
            body = f"<div{self.css('wrapper', 'container', 'page')}>{body}{self.side() if self.chance(0.4) else ''}</div>"
        before = [m() for m, share in ((self.notice, 0.3), (self.head, 0.45), (self.menu, 0.75), (self.advert, 0.45), (self.side, 0.15), (self.search, 0.1)) if self.chance(share)]
        after = [m() for m, share in ((self.talk, 0.3), (self.related, 0.25), (self.side, 0.3), (self.advert, 0.2), (self.form, 0.15), (self.foot, 0.85), (self.notice, 0.15)) if self.chance(share)]
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head><body>"
        source = head + "".join(before) + "<!-- x -->" * self.chance(0.3) + body + "".join(after) + "</body></html>" * self.chance(0.9)
        return source


def sample_pages(count: int, seed: int = 10) -> list[str]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(count)]
