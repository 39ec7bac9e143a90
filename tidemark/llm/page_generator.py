"""Generated pages with a known label for every block, to train and test the block labeller.

Words are invented, so a label hangs on structure and on how a block stands among others, as it must for any language.
"""

from __future__ import annotations

import random

import numpy as np

from tidemark.llm.html_blocks import blocks, vectors

#: Private-use characters that mark text of the article and other text; they never reach the features.
MAIN, OTHER = "", ""

_ONSETS = ["", "b", "ch", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "st", "t", "th", "v", "w", "z"]
_VOWELS = ["a", "e", "i", "o", "u", "ea", "ou", "é", "ä", "ó", "ê"]
_LABELS = "home about contact menu search login share reply comment subscribe newsletter cookies accept privacy terms copyright advertisement sponsored related more next previous tags".split()


class Pages:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        r = self.rng
        return "".join(r.choice(_ONSETS) + r.choice(_VOWELS) for _ in range(r.choice([1, 1, 2, 2, 3])))

    def words(self, low: int, high: int, labels: float = 0.0) -> str:
        r = self.rng
        out = [r.choice(_LABELS) if r.random() < labels else self.word() for _ in range(r.randint(low, high))]
        if r.random() < 0.6:
            out[0] = out[0].capitalize()
        return " ".join(out) + r.choice(["", ".", ".", "!", ","])

    def sentences(self, low: int, high: int) -> str:
        r = self.rng
        text = " ".join(self.words(1, r.choice([2, 24, 24])) for _ in range(r.choice([low, r.randint(low, high)])))
        style = r.random()
        if style < 0.1:
            text = " ".join(w + r.choice(["***", "###", "%%%", "$$$", "&amp;", "!!"]) for w in text.split())
        elif style < 0.2:
            text = r.choice([" | ", "!! ", " "]).join(text.split())
        if style < 0.05 or style > 0.9:
            text = text.upper()
        return text

    def inline(self, text: str) -> str:
        r = self.rng
        parts = text.split(" ")
        for _ in range(r.choice([0, 0, 1, 2])):
            i = r.randrange(len(parts))
            parts[i] = r.choice(["<b>{}</b>", "<i>{}</i>", "<a href='/x'>{}</a>", "<em>{}</em>", "<b>{}", "{}<br>", "<span class='x'>{}</span>"]).format(parts[i])
        return " ".join(parts)

    def element(self, tags: str, names: str, body: str) -> str:
        """One of the tags with one of the names as its class or id, or without a name if the list has '-'."""
        r = self.rng
        tag, name = r.choice(tags.split()), r.choice(names.split())
        kind = r.choice(["class", "class", "id"])
        own = "" if name == "-" else f' {kind}="{name}{r.choice(["", "", "", "-" + self.word(), " " + self.word()])}"'
        return f"<{tag}{own}>{body}</{tag}>"

    def links(self, low: int, high: int) -> str:
        r = self.rng
        items = [f'<a href="/{self.word()}">{OTHER}{self.words(1, 3, 0.3)}</a>' for _ in range(r.randint(low, high))]
        form = r.randrange(3)
        if form == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<div>{x}</div>" for x in items) if form == 1 else " ".join(items)

    def other(self, kind: str) -> str:
        r, say = self.rng, lambda low, high: OTHER + self.words(low, high, 0.2)
        long = lambda: OTHER + self.sentences(1, 3)
        if kind == "menu":
            return self.element("nav nav div ul", "- - menu nav navigation navbar topnav breadcrumb breadcrumbs", self.links(3, 8))
        if kind == "header":
            return self.element("header header div", "- header top masthead site-header banner logo", r.choice([say(1, 6), f"<h1>{say(1, 4)}</h1>", f"<p>{say(2, 9)}</p>", self.links(2, 5)]))
        if kind == "side":
            body = "".join(f"<h3>{say(1, 4)}</h3>" + r.choice([self.links(2, 6), f"<p>{long()}</p>"]) for _ in range(r.randint(1, 3)))
            return self.element("aside", "- sidebar widget related", body) if r.random() < 0.5 else self.element("div section", "sidebar side widget related recommended trending popular", body)
        if kind == "footer":
            body = r.choice([say(3, 12), f"&copy; {say(2, 8)} &middot; {self.words(1, 6)}", f"<p>{say(3, 10)}</p>", f"<p>{long()}</p>", self.links(2, 6)])
            return self.element("footer", "- - footer bottom", body) if r.random() < 0.6 else self.element("div", "footer bottom site-footer copyright legal", body)
        if kind == "ad":
            return self.element("div div ins aside", "ad ads advert advertisement sponsor sponsored promo banner adslot", r.choice([say(1, 8), f"<p>{say(3, 12)}</p>", long(), self.links(1, 2)]))
        if kind == "notice":
            return self.element("div div section p", "cookie cookies consent notice alert gdpr popup modal overlay warning message", r.choice([say(4, 14), f"<p>{long()}</p>", long()]))
        if kind == "form":
            return self.element("form", "- search newsletter login subscribe signup", r.choice([f"<label>{say(1, 4)}</label><input>", f"<p>{say(2, 8)}</p><input>", f"<div>{say(1, 5)}</div><button>{say(1, 2)}</button>"]))
        if kind == "share":
            return self.element("div ul", "share social tags meta byline pagination toolbar", r.choice([say(1, 5), self.links(2, 5)]))
        body = "".join(self.element("div li article section", "comment comment-item reply response", r.choice([f"<p>{long()}</p>", f"<b>{say(1, 2)}</b><p>{long()}</p>", long()])) for _ in range(r.randint(1, 5)))
        return self.element("section div ol ul", "comments comment-list responses discussion respond", r.choice(["", f"<h2>{say(1, 3)}</h2>", f"<h3>{say(1, 3)}</h3>"]) + body)

    def article(self) -> str:
        r, out = self.rng, []
        if r.random() < 0.8:
            heading = f"<{(t := r.choice(['h1', 'h1', 'h2']))}>{MAIN}{self.words(3, 12)}</{t}>"
            out.append(heading if r.random() < 0.85 else f"<header>{heading}</header>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            form = r.random()
            text = lambda low, high: MAIN + self.inline(self.sentences(low, high))
            if form < 0.75:
                out.append(f"<p>{text(1, 6)}" + r.choice(["</p>", "</p>", ""]))
            elif form < 0.8:
                out.append(f"<h{(k := r.choice('23'))}>{MAIN}{self.words(1, 8)}</h{k}>")
            elif form < 0.85:
                out.append("<ul>" + "".join(f"<li>{text(1, 1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif form < 0.88:
                out.append(f"<blockquote><p>{text(1, 2)}</p></blockquote>")
            elif form < 0.9:
                out.append("<table>" + "".join(f"<tr><td>{MAIN}{self.words(1, 4)}</td><td>{MAIN}{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif form < 0.92:
                out.append(f"<pre>{text(1, 2)}</pre>")
            elif form < 0.94:
                out.append(f"<div>{text(1, 3)}</div>")
            else:
                out.append(self.other(r.choice(["ad", "share", "notice", "side", "form"])))
        body = "\n".join(out)
        if r.random() < 0.2:
            body = f"<div>{body}</div>"
        frame = r.random()
        if frame < 0.45:
            return self.element("article", "- - - post entry story", body)
        if frame < 0.6:
            return f"<main>{self.element('article div section', '- content post', body)}</main>"
        return self.element("div section td", "content article post entry entry-content article-body story text body main post-content", body)

    def page(self) -> str:
        r = self.rng
        before = [k for k in ("notice", "header", "menu", "ad", "form", "side") if r.random() < (0.7 if k == "menu" else 0.35)]
        after = [k for k in ("share", "ad", "side", "comments", "form", "footer", "notice") if r.random() < (0.75 if k == "footer" else 0.35)]
        if r.random() < 0.3:
            r.shuffle(before)
        body = "\n".join([*(self.other(k) for k in before), self.article(), *(self.other(k) for k in after)])
        if r.random() < 0.3:
            body = self.element("div", "- page wrapper container site", body)
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + r.choice(["</body></html>", ""])


def example(page: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Vectors and labels of a generated page, and the article's text."""
    leaves = blocks(page)
    labels = np.array([MAIN in b.text for b in leaves], dtype=np.float32)
    for b in leaves:
        b.text = " ".join(b.text.replace(MAIN, "").replace(OTHER, "").split())
    return vectors(leaves), labels, "\n\n".join(b.text for b, y in zip(leaves, labels) if y)


def plain(page: str) -> str:
    return page.replace(MAIN, "").replace(OTHER, "")
