"""Labelled pages that the extraction model is trained on, made from page layouts and invented words.

Layouts differ in what holds the article (semantic elements, named boxes, table cells, nothing at all), in which other
parts surround or interrupt it, and in how these are named. A page comes with the texts of its main blocks.
"""

from __future__ import annotations

import random

# Names that page authors give to the article's box, to boxes of any kind, and to every other part.
ARTICLE_NAMES = "content post entry article story main body text post-content entry-content article-body main-content page-content prose markdown blog-post single".split()
BOX_NAMES = "wrapper container row col inner box block clearfix layout wrap grid section site page outer group".split()
OTHER = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs main-menu site-nav links pagination pager toc tabs".split(),
    "header": "header site-header masthead top banner logo brand branding topbar page-header".split(),
    "footer": "footer site-footer bottom copyright legal colophon page-footer credits imprint".split(),
    "aside": "sidebar aside widget related recommended side popular trending tags right-col secondary more-stories".split(),
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay message warning privacy banner toast paywall".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense teaser banner-ad commercial partner".split(),
    "form": "form newsletter subscribe search login signup search-form contact-form register searchbox".split(),
    "share": "share social sharing social-links follow buttons share-bar toolbar tools".split(),
    "comments": "comments comment comment-list responses discussion replies disqus reader-comments feedback comment-body".split(),
}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "notice": "dialog"}
SYLLABLES = "ba ce di fo gu la me ni po ru sta tre vi wo xe yu zan bel cor den fil gom hun jas kel lim mor nup".split()


class _Writer:
    def __init__(self, rng: random.Random) -> None:
        self.rng, self.main = rng, set()

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 16) -> str:
        return self.words(low, high).capitalize() + self.rng.choice([".", ".", ".", "!", "?"])

    def prose(self, low: int = 1, high: int = 7) -> str:
        text = " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))
        style = self.rng.random()
        if style < 0.08:
            return text.upper().replace(" ", "!! ")
        if style < 0.16:
            return " ".join(w + self.rng.choice(["***", "###", "%%%", ""]) for w in text.split())
        if style < 0.22:
            return text.replace(" ", " | ")
        return self.sentence(1, 3) if style < 0.34 else text

    def attributes(self, names: list[str], chance: float = 1.0) -> str:
        rng, found = self.rng, []
        if rng.random() < chance:
            found.append(rng.choice(names))
        if rng.random() < 0.3:
            found.append(rng.choice(BOX_NAMES))
        if rng.random() < 0.2:
            found.append(self.word() + str(rng.randint(1, 99)))
        rng.shuffle(found)
        if not found:
            return ""
        return f' {rng.choice(["class", "class", "class", "id"])}="{" ".join(found)}"'

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.rng.choice([0, 0, 0, 1, 2])):
            i = self.rng.randrange(len(words))
            tag = self.rng.choice(["b", "em", "i", "strong", 'a href="/x"', "span", "code"])
            words[i] = f"<{tag}>{words[i]}</{tag.split()[0]}>"
        return " ".join(words)

    def part(self, kind: str) -> str:
        """Some part that is not main text."""
        rng = self.rng
        link = lambda: f'<a href="/{self.word()}">{self.words(1, 4)}</a>'
        if kind in ("nav", "share"):
            items = [link() for _ in range(rng.randint(2, 8))]
            body = rng.choice([lambda: "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", lambda: " ".join(items)])()
        elif kind == "header":
            body = rng.choice([f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 3)}</div>", f"<p>{link()}</p>"]) + rng.choice(["", f"<p>{self.sentence()}</p>"])
        elif kind == "footer":
            body = rng.choice([f"&copy; {rng.randint(1999, 2030)} {self.words(1, 3)}", f"<p>{self.prose(1, 3)}</p>", f"&copy; {self.word()}.example &middot; {self.prose(1, 2)}", f"<p>Copyright {self.words(1, 3)}</p><ul><li>{link()}</li><li>{link()}</li></ul>"])
        elif kind == "aside":
            body = f"<h3>{self.words(1, 3)}</h3>" * rng.randint(0, 1) + rng.choice([f"<ul><li>{link()}</li><li>{link()}</li></ul>", f"<p>{self.prose(1, 3)}</p>", f"<div>{link()}</div>"])
        elif kind == "form":
            body = rng.choice(["", f"<p>{self.sentence()}</p>"]) + f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>"
        elif kind == "comments":
            body = f"<h3>{self.words(1, 3)}</h3>" * rng.randint(0, 1) + "".join(
                rng.choice([f"<li><b>{self.word()}</b><p>{self.prose(1, 4)}</p></li>", f'<div class="{rng.choice(OTHER["comments"])}"><p>{self.prose(1, 4)}</p></div>', f"<p>{self.prose(1, 4)}</p>"])
                for _ in range(rng.randint(1, 4))
            )
        else:
            text = self.prose(1, 3)
            body = rng.choice([text, f"<p>{text}</p>", f"<p>{text}</p>{link()}", f"<div>{text}<button>{self.words(1, 2)}</button></div>"])
        named = rng.random() < 0.65
        tag = TAGS.get(kind, "div") if not named or rng.random() < 0.4 else rng.choice(["div", "div", "section", "aside"])
        needs_name = tag in ("div", "section") or rng.random() < 0.3
        return f"<{tag}{self.attributes(OTHER[kind], 1.0 if needs_name else 0.0)}>{body}</{tag}>"

    def block(self, tag: str, text: str) -> str:
        self.main.add(" ".join(text.split()))
        end = "" if tag == "p" and self.rng.random() < 0.1 else f"</{tag}>"
        return f"<{tag}>{self.inline(text)}{end}"

    def article(self) -> str:
        rng = self.rng
        out = [self.block(rng.choice(["h1", "h1", "h2"]), self.words(2, 9) if rng.random() < 0.8 else self.prose(1, 1))]
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
            kind = rng.random()
            if kind < 0.68:
                out.append(self.block("p", self.prose()))
            elif kind < 0.74:
                out.append(self.block(rng.choice(["h2", "h3"]), self.words(1, 6)))
            elif kind < 0.80:
                items = "".join(self.block("li", self.prose(1, 2)) for _ in range(rng.randint(1, 4)))
                out.append(f"<ul>{items}</ul>" if rng.random() < 0.6 else f"<ol>{items}</ol>")
            elif kind < 0.84:
                out.append(f"<blockquote>{self.block('p', self.prose(1, 2))}</blockquote>")
            elif kind < 0.87:
                out.append(self.block("pre", self.words(2, 8)))
            elif kind < 0.90:
                out.append(f"<table><tr>{self.block('td', self.words(1, 4))}{self.block('td', self.words(1, 4))}</tr></table>")
            elif kind < 0.93:
                out.append(f"<figure><img src=x>{self.block('figcaption', self.sentence())}</figure>")
            else:
                out.append(self.part(rng.choice(["ad", "share", "aside", "form", "notice"])))
        if rng.random() < 0.15:
            out.append(self.part(rng.choice(["comments", "share", "footer"])))
        return "".join(out)

    def page(self) -> str:
        rng = self.rng
        body = self.article()
        holder = rng.random()
        if holder < 0.4:
            body = f"<article{self.attributes(ARTICLE_NAMES, 0.3)}>{body}</article>"
        elif holder < 0.75:
            body = f"<{(t := rng.choice(['div', 'div', 'section', 'td']))}{self.attributes(ARTICLE_NAMES)}>{body}</{t}>"
        if rng.random() < 0.4:
            body = f"<main>{body}</main>"
        if rng.random() < 0.3:
            body = f"<div{self.attributes(BOX_NAMES)}>{body}</div>"
        before = [self.part(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if rng.random() < 0.45]
        after = [self.part(k) for k in ("share", "comments", "aside", "ad", "nav", "notice", "form", "footer") if rng.random() < 0.4]
        if rng.random() < 0.5:
            rng.shuffle(before)
        title = f"<title>{self.words(2, 8)}</title>"
        page = f"<!DOCTYPE html><html><head><meta charset=utf-8>{title}<script>var a = '<p>x</p>';</script></head><body>"
        page += "".join(before) + body + "".join(after) + "</body></html>"
        return page if rng.random() < 0.7 else page.replace("><", ">\n<")


def training_pages(n: int, seed: int) -> list[tuple[str, set[str]]]:
    """``n`` pages with the texts of their main blocks; the same ``seed`` gives the same pages."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        writer = _Writer(rng)
        page = writer.page()
        out.append((page, writer.main))
    return out
