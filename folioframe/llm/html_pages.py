"""Labelled web pages for training the main-text extractor.

Pages are made by rule from a seed: layouts of menus, headers, notices,
adverts, sidebars, forms, comments and footers around an article, in invented
words.  Some pages begin or end with their article, some have nothing else, some
no tags at all.  The article stands in a telling element, in one with a name
that says nothing, in nested ones, in a table's cell or right in the body, has
one paragraph or many, and by-lines, asides, forms, adverts and reader comments
stand within it, too.  Every piece of text knows whether it belongs to
the article, so the labels are exact.  ``OTHERS`` are layouts kept out of
training, to see how the extractor does on pages unlike those it learned from.
"""

from __future__ import annotations

import random

# Usual names of page parts in class and id attributes.
CONTENT_NAMES = ["content", "main", "post", "entry", "article", "story", "body", "text", "article-body", "post-content"]
NOISE_NAMES = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager"],
    "header": ["header", "masthead", "topbar", "banner", "site-title", "logo"],
    "footer": ["footer", "copyright", "site-info", "colophon", "legal"],
    "aside": ["sidebar", "related", "widget", "recommended", "trending", "side", "more"],
    "notice": ["cookie", "consent", "notice", "alert", "gdpr", "popup", "modal", "subscribe", "newsletter", "paywall"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "sponsor"],
    "share": ["share", "social", "tags", "meta", "byline", "toolbar"],
    "byline": ["byline", "author", "dateline", "meta", "posted", "published"],
    "comments": ["comments", "comment", "comment-list", "commentlist", "reply", "discussion", "respond"],
}
#: The mark of article text in a generated page (a private-use letter).
MARK = ""


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        letters = "etaoinshrdlucmfwypvbgkjqxzéäöüñç"
        self.words = ["".join(rng.choices(letters, weights=range(len(letters), 0, -1), k=rng.randint(1, 9))) for _ in range(120)]

    def prose(self, low: int, high: int) -> str:
        """Sentences of ``low`` to ``high`` words in all."""
        out, left = [], self.rng.randint(low, high)
        odd = self.rng.random()
        if odd < 0.12:  # texts without sentences, as lists, logs or tables leave them
            sign = self.rng.choice(["", "", " |", "###", "%%", " 12", ":"])
            return " ".join(w + sign for w in self.rng.choices(self.words, k=left))
        while left > 0:
            n = min(left, self.rng.randint(2, 16))
            words = self.rng.choices(self.words, k=n)
            out.append(" ".join(words).capitalize().replace(" ", ", ", int(self.rng.random() < 0.3)) + self.rng.choice("....?!"))
            left -= n
        return " ".join(out)

    def label(self) -> str:
        return " ".join(self.rng.choices(self.words, k=self.rng.randint(1, 4))).capitalize()

    def noise(self, kind: str) -> str:
        rng, name = self.rng, self.rng.choice(NOISE_NAMES[kind])
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "byline": "header", "comments": "section"}.get(kind, "div")
        if kind in ("footer", "nav", "header") and rng.random() < 0.1:  # no telling name
            start, tag = f"<div{self.vague()}>", "div"
        elif rng.random() < 0.5:
            start, tag = (f"<{tag}>", tag) if kind in ("nav", "header", "footer", "aside") else (f'<div class="{name}">', "div")
        else:
            tag = rng.choice([tag, "div", "section"])
            start = f'<{tag} {rng.choice(["class", "id"])}="{name}{rng.choice(["", " box", "-" + str(rng.randint(1, 9))])}">'
        links = lambda n: "".join(f'<li><a href="/{i}">{self.label()}</a></li>' for i in range(n))
        prose = {
            "nav": lambda: f"<ul>{links(rng.randint(3, 9))}</ul>",
            "header": lambda: f"<h1>{self.label()}</h1><p>{self.prose(2, 8)}</p>" if rng.random() < 0.5 else f'<a href="/">{self.label()}</a>',
            "footer": lambda: rng.choice([f"&copy; {self.label()} &middot; {self.prose(3, 30)}", f"Copyright {rng.randint(1996, 2026)} {self.label()}", f"<p>{self.prose(3, 20)} All rights reserved.</p>", f"<ul>{links(3)}</ul><p>{self.prose(2, 12)}</p>"]),
            "aside": lambda: f"<h3>{self.label()}</h3><ul>{links(rng.randint(2, 6))}</ul>" + (f"<p>{self.prose(5, 40)}</p>" if rng.random() < 0.5 else ""),
            "notice": lambda: f"<p>{self.prose(5, 40)}</p><button>{self.label()}</button>",
            "ad": lambda: self.prose(3, 40) if rng.random() < 0.6 else f'<a href="http://ad.example/">{self.prose(3, 15)}</a>',
            "share": lambda: f"<span>{self.label()}</span> <a>{self.label()}</a> <a>{self.label()}</a>",
            "byline": lambda: f"<p>{self.label()}, <a href='/by'>{self.label()}</a>, {rng.randint(1, 30)}.{rng.randint(1, 12)}.{rng.randint(1999, 2026)}</p>" if rng.random() < 0.5 else f"{self.label()} <time>{rng.randint(1999, 2026)}</time>",
            "comments": lambda: self.comments(),
        }[kind]()
        return f"{start}{prose}</{tag}>"

    def comments(self) -> str:
        """Readers' words, in boxes or in a list."""
        rng, n = self.rng, self.rng.randint(1, 5)
        said = [f"<b>{self.label()}</b><p>{self.prose(2, 80)}</p>" for _ in range(n)]
        head = f"<h3>{self.label()}</h3>" if rng.random() < 0.7 else ""
        if rng.random() < 0.4:
            tag = rng.choice(["ol", "ul"])
            return head + f'<{tag} class="{rng.choice(NOISE_NAMES["comments"])}">' + "".join(f"<li>{x}</li>" for x in said) + f"</{tag}>"
        return head + "".join(f'<div class="comment">{x}</div>' for x in said)

    def loose(self) -> str:
        """An article without paragraph tags: boxes, or lines with breaks between."""
        rng, n = self.rng, self.rng.randint(1, 5)
        texts = [MARK + self.prose(8, 90) for _ in range(n)]
        head = f"<h1>{MARK}{self.prose(1, 10)}</h1>" if rng.random() < 0.5 else ""
        kind = rng.random()
        if kind < 0.4:
            return head + "".join(f"<div{self.vague() if rng.random() < 0.3 else ''}>{t}</div>" for t in texts)
        if kind < 0.7:
            return head + rng.choice(["<br><br>", "<br/>", "<p>"]).join(texts)
        return (f"<center><h2>{MARK}{self.prose(1, 8)}</h2></center>" if rng.random() < 0.5 else head) + f"<font size=3>{'<p>'.join(texts)}</font>"

    def form(self) -> str:
        return f"<form><label>{self.label()}</label><input><select><option>{self.label()}</option></select><button>{self.label()}</button></form>"

    def vague(self) -> str:
        """No attribute, or a class that says nothing of its element's content."""
        rng = self.rng
        return "" if rng.random() < 0.4 else f' class="{rng.choice(VAGUE)}{rng.choice(["", "-" + rng.choice(VAGUE), str(rng.randint(1, 99))])}"'

    def article(self) -> str:
        rng, out = self.rng, []
        mark = lambda t: MARK + t
        few = rng.random() < 0.25  # one or two paragraphs, often with something between them
        if rng.random() < (0.4 if few else 0.85):
            out.append(f"<h1>{mark(self.prose(1, 12))}</h1>")
        if rng.random() < 0.2:
            out.append(self.noise("byline"))
        if few:
            for i in range(rng.randint(1, 2)):
                between = rng.random()
                if i and between < 0.5:
                    out.append(self.form() if between < 0.15 else self.noise(rng.choice(["aside", "ad", "notice", "share"])))
                out.append(f"<p>{mark(self.prose(6, 60))}</p>")
        for _ in range(0 if few else rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.62:
                inner = mark(self.prose(1, rng.choice([4, 120])))
                if rng.random() < 0.15:
                    inner = f'{inner}<img src="/{rng.randint(1, 9)}.png">'
                if rng.random() < 0.3:
                    inner = f"<b>{inner}" + ("</b>" if rng.random() < 0.5 else "<br>")
                out.append(f"<p>{inner}" + ("</p>" if rng.random() < 0.8 else ""))
            elif kind < 0.7:
                out.append(f"<h2>{mark(self.label())}</h2>")
            elif kind < 0.78:
                out.append("<ul>" + "".join(f"<li>{mark(self.prose(2, 25))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.82:
                out.append(f"<blockquote><p>{mark(self.prose(4, 40))}</p></blockquote>")
            elif kind < 0.85:
                out.append("<table>" + "".join(f"<tr><td>{mark(self.label())}</td><td>{mark(self.label())}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>")
            elif kind < 0.87:
                out.append(f"<pre>{mark(self.prose(2, 20))}</pre>")
            else:
                out.append(self.noise(rng.choice(["ad", "share", "aside", "notice"])) if rng.random() < 0.7 else self.form())
        if rng.random() < 0.2:
            out.append(self.comments() if rng.random() < 0.5 else self.noise("comments"))
        body = "".join(out)
        wrap = rng.random()
        if wrap < 0.25:
            return f"<article>{body}</article>"
        if wrap < 0.38:
            return f"<main{rng.choice(['', self.vague()])}>{body}</main>"
        if wrap < 0.52:
            return body
        if wrap < 0.67:
            return f'<div {rng.choice(["class", "id"])}="{rng.choice(CONTENT_NAMES)}">{body}</div>'
        tags = rng.choices(["div", "section"], weights=[3, 1], k=rng.randint(1, 4))
        return "".join(f"<{t}{self.vague()}>" for t in tags) + body + "".join(f"</{t}>" for t in reversed(tags))

    def html(self) -> str:
        rng = self.rng
        some = lambda kind, p: self.noise(kind) if rng.random() < p else ""
        top = some("notice", 0.2) + some("header", 0.4) + some("nav", 0.7) + some("ad", 0.4) + some("aside", 0.2)
        low = some("share", 0.2) + some("comments", 0.35) + some("aside", 0.3) + some("ad", 0.2) + (self.form() if rng.random() < 0.2 else "") + some("notice", 0.1) + some("footer", 0.8)
        bounds = rng.random()
        if bounds < 0.02:
            return MARK + self.prose(10, 120)
        if bounds < 0.3:  # nothing before, nothing behind, or neither
            top, low = ("", low) if bounds < 0.12 else (top, "") if bounds < 0.2 else ("", "")
        inner = f"{top}{self.loose() if rng.random() < 0.12 else self.article()}{low}"
        if rng.random() < 0.1:  # a table as the page's frame
            inner = f"<table><tr><td{self.vague()}>{some('nav', 0.8)}{some('aside', 0.5)}</td><td{self.vague()}>{self.article()}</td><td>{some('ad', 0.6)}</td></tr>" + (f"<tr><td colspan=3>{rng.choice(['&copy;', 'Copyright'])} {rng.randint(1996, 2026)} {self.label()}. {self.prose(2, 12)}</td></tr></table>" if rng.random() < 0.4 else f"</table>{some('footer', 0.8)}")
        return f"<html><head><title>{self.label()}</title><style>p{{}}</style></head><body>{inner}" + ("</body></html>" if rng.random() < 0.8 else "")

    def other(self) -> str:
        """A page of a layout in ``OTHERS``."""
        rng, mark = self.rng, lambda t: MARK + t
        prose = "".join(f"<p>{mark(self.prose(20, 120))}</p>" for _ in range(rng.randint(2, 8)))
        return OTHERS[rng.choice(sorted(OTHERS))].format(title=mark(self.prose(3, 9)), prose=prose, quote=mark(self.prose(8, 30)), nav=self.noise("nav"), footer=self.noise("footer"), comments=self.noise("comments"), byline=self.noise("byline"), links="".join(f'<li><a href="/{i}">{self.label()}</a></li>' for i in range(6)), label=self.label(), small=self.prose(3, 12))


#: Class names that say nothing of the content.
VAGUE = "box wrap inner outer row col grid left center page area block unit cell panel mw parser output container section layout site".split()
#: Layouts that no training page has.
OTHERS = {
    "wiki": '<body><div class="mw-page"><div id="mw-panel"><ul>{links}</ul></div><div class="content-area"><div class="mw-parser-output"><h1>{title}</h1>{prose}<blockquote>{quote}</blockquote></div></div></div>{footer}</body>',
    "old table": '<body><table width="90%"><tr><td colspan="2">{label}</td></tr><tr><td><ul>{links}</ul></td><td><h2>{title}</h2>{prose}</td></tr><tr><td colspan="2">&copy; {label}. {small}</td></tr></table></body>',
    "deep": '<body><div id="root"><div><div>{nav}</div><div><div><section><div class="q7"><h1>{title}</h1><div>{byline}</div><div class="z9">{prose}</div><div>{comments}</div></div></section></div></div>{footer}</div></div></body>',
    "comments inside": "<body>{nav}<article><header><h2>{label}</h2></header>{prose}<section class=\"comments\"><h3>{label}</h3><p>{small}</p></section></article>{footer}</body>",
    "sections": "<body>{nav}<section><h1>{title}</h1>{byline}{prose}</section><section><h2>{label}</h2><ul>{links}</ul></section>{footer}</body>",
}


def labelled_pages(n: int, seed: int = 7, others: bool = False) -> list[str]:
    """``n`` pages, or pages of ``OTHERS``, in which article text begins with ``MARK``."""
    made = (_Page(random.Random(f"{seed}/{i}")) for i in range(n))
    return [page.other() if others else page.html() for page in made]
