"""Labelled pages to learn extraction from: pages of many layouts, written by rule, whose main text is marked.

``data-main="1"`` marks an element as main text, ``data-main="0"`` as furniture; an element without the mark has that of
its parent. Layouts differ in how the article is wrapped, in what stands around and inside it, and in whether names of
elements and classes tell anything at all. Words are made up of syllables.
"""

import random

#: How sites name the parts of a page.
NAMES = {
    "main": "content post entry-content article-body story main-content post-body text article page-content body-text "
    "entry prose single-post hentry mw-parser-output news-text blog-post",
    "menu": "menu nav navbar navigation main-nav top-menu breadcrumb breadcrumbs topbar site-nav toc tabs skip-links mega-menu pagination pager",
    "header": "header site-header masthead page-header top banner-top branding logo hero site-title tagline",
    "footer": "footer site-footer page-footer bottom colophon copyright legal credits footnotes-site imprint",
    "side": "sidebar aside side-bar widget related related-posts recent recommended rail right-column left-column trending popular "
    "more-stories teaser blogroll tags tag-cloud author-box infobox-links read-more most-read",
    "ad": "ad ads advert advertisement ad-banner sponsored promo promotion adsbox ad-slot sponsor google-ads commercial anzeige publicidad outbrain taboola",
    "notice": "cookie cookie-notice notice alert consent gdpr popup modal overlay banner newsletter paywall warning message privacy-notice "
    "announcement toast subscribe-box disclaimer",
    "form": "form search-form searchbox login signup subscribe contact-form newsletter-form comment-form respond input-group poll",
    "comments": "comments comment-list commentlist discussion disqus replies user-comments responses reader-comments feedback comment thread comment-body",
    "share": "share social share-buttons social-links sharing addthis toolbar follow-us print-links actions",
}
NAMES = {kind: names.split() for kind, names in NAMES.items()}
#: Words of menus and notices.
LABELS = "Home News Sport Contact About Login Search Help Archive Blog Shop Start Menü Suche Kontakt Inicio Accueil Impressum".split()
NOTICES = (
    "We use cookies to improve your experience.", "Accept all cookies", "Subscribe to our newsletter", "Please enable JavaScript.",
    "Diese Seite verwendet Cookies. Datenschutz", "Ce site utilise des cookies.", "Este sitio usa cookies.", "You have 3 free articles left.",
)
SYLLABLES = "an er on the re st in ti or ed ly wh ble ein sch lich ung des eau ment que ción os as za do é ü ñ".split()


def _words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def _sentences(rng, n):
    out = []
    for _ in range(n):
        words = _words(rng, rng.choice((1, 2, 4, 8, 12, 20)))
        out.append(" ".join(words).capitalize() + rng.choice(".....!?"))
    return " ".join(out)


def _mark(main):
    return f' data-main="{int(main)}"'


class _Writer:
    def __init__(self, rng):
        self.rng = rng
        # a third of all sites name nothing, so that shape has to tell; a part of a page keeps its style
        self.named = rng.random() < 0.7
        self.semantic = rng.random() < 0.6

    def name(self, kind):
        if not self.named:
            return ""
        words = self.rng.sample(NAMES[kind], self.rng.choice((1, 1, 2)))
        return self.rng.choice((f' class="{" ".join(words)}"', f' id="{words[0]}"', f' class="{words[0]}" id="{words[-1]}-{self.rng.randint(1, 9)}"'))

    def part(self, kind, tag, inside, role=""):
        tag = tag if self.semantic and tag else "div"
        named = self.name(kind) if tag == "div" or self.rng.random() < 0.4 else ""
        return f"<{tag}{named}{role}{_mark(False)}>{inside}</{tag}>"

    def links(self, n, long=False):
        rng = self.rng
        texts = [" ".join(_words(rng, rng.randint(4, 9))) if long else rng.choice((rng.choice(LABELS), _words(rng, 1)[0])) for _ in range(n)]
        links = [f'<a href="/{i}">{t}</a>' for i, t in enumerate(texts)]
        return rng.choice((
            lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>",
            lambda: "<ul>" + "".join(f"<li>{x}" for x in links) + "</ul>",
            lambda: rng.choice((" | ", " ", " · ")).join(links),
            lambda: "".join(f"<div>{x}</div>" for x in links),
        ))()

    def heading(self, words):
        level = self.rng.randint(2, 4)
        return f"<h{level}>{' '.join(_words(self.rng, words))}</h{level}>"

    def menu(self):
        role = ' role="navigation"' if self.rng.random() < 0.1 else ""
        return self.part("menu", "nav", self.links(self.rng.randint(2, 9)), role)

    def header(self):
        rng = self.rng
        inside = rng.choice((
            f'<a href="/">{_words(rng, 2)[0]}</a>', f"<h1>{_words(rng, 1)[0]}</h1><p>{_sentences(rng, 1)}</p>",
            f"<div>{' '.join(_words(rng, 3))}</div>{self.links(4)}", self.links(5), f"<p>{_sentences(rng, 1)}</p>",
        ))
        return self.part("header", "header", inside)

    def footer(self):
        rng = self.rng
        inside = rng.choice((
            f"&copy; {_words(rng, 1)[0]}.example &middot; {_sentences(rng, rng.randint(1, 3))}",
            f"<p>&copy; 20{rng.randint(10, 29)} {' '.join(_words(rng, 3))}. All rights reserved.</p>{self.links(4)}",
            self.links(rng.randint(2, 6)), f"<p>{_sentences(rng, 2)}</p>", f"{_sentences(rng, 1)}<br>{_sentences(rng, 1)}",
        ))
        return self.part("footer", "footer", inside)

    def side(self):
        rng = self.rng
        inside = self.heading(2) if rng.random() < 0.7 else ""
        inside += rng.choice((
            lambda: self.links(rng.randint(3, 8), long=True), lambda: f"<p>{_sentences(rng, rng.randint(1, 3))}</p>",
            lambda: f"{_sentences(rng, 2)} <a href=/x>{_words(rng, 1)[0]}</a>",
        ))()
        return self.part("side", "aside", inside, ' role="complementary"' if rng.random() < 0.1 else "")

    def ad(self):
        rng = self.rng
        inside = rng.choice((
            _sentences(rng, rng.randint(1, 3)), f"<p>{_sentences(rng, 2)}</p>", f'<a href="/ad"><b>{_sentences(rng, 1)}</b></a>',
            f"<span>Advertisement</span> {_sentences(rng, 1)}",
        ))
        tag = rng.choice(("div", "div", "section", "p", "ins"))
        return f'<{tag} class="{rng.choice(NAMES["ad"])}"{_mark(False)}>{inside}</{tag}>'

    def notice(self):
        rng = self.rng
        inside = rng.choice((rng.choice(NOTICES), f"<p>{rng.choice(NOTICES)} {_sentences(rng, 1)}</p><button>OK</button>", f"<p>{_sentences(rng, 2)}</p>"))
        tag, role = rng.choice((("div", ""), ("div", ' role="dialog"'), ("div", ' role="alert"'), ("dialog", ""), ("section", "")))
        return f'<{tag} class="{rng.choice(NAMES["notice"])}"{role}{_mark(False)}>{inside}</{tag}>'

    def form(self):
        rng = self.rng
        rows = "".join(rng.choice((
            f"<label>{rng.choice(LABELS)}</label><input name=q>", f"<p>{_sentences(rng, rng.randint(1, 3))}</p>",
            f"{_sentences(rng, 2)}", f"<div>{_sentences(rng, 1)}</div>", "<select><option>A<option>B</select>",
            "<textarea>Your text</textarea>", f"<fieldset><legend>{_words(rng, 1)[0]}</legend>{_sentences(rng, 1)}</fieldset>",
        )) for _ in range(rng.randint(1, 3)))
        return f"<form{self.name('form')}{_mark(False)}>{rows}<button>{rng.choice(LABELS)}</button></form>"

    def comments(self):
        rng = self.rng
        one = lambda: f"{' '.join(_words(rng, 2))}: {_sentences(rng, rng.randint(1, 5))}"
        many = [one() for _ in range(rng.randint(1, 5))]
        name = rng.choice(NAMES["comments"])
        inside = rng.choice((
            lambda: "<h3>Comments</h3><ol>" + "".join(f'<li class="comment">{c}</li>' for c in many) + "</ol>",
            lambda: "".join(f'<div class="comment"><b>{_words(rng, 1)[0]}</b><p>{c}</p></div>' for c in many),
            lambda: "".join(f"<article><p>{c}</p></article>" for c in many),
            lambda: f"<h2>{len(many)} comments</h2>" + "".join(f"<p>{c}</p>" for c in many),
        ))()
        tag = rng.choice(("section", "div", "ol", "ul", "aside"))
        return f'<{tag} {rng.choice(("class", "id"))}="{name}"{_mark(False)}>{inside}</{tag}>'

    def share(self):
        return f'<div class="{self.rng.choice(NAMES["share"])}"{_mark(False)}>{self.links(3)}</div>'

    def paragraph(self):
        rng = self.rng
        text = _sentences(rng, rng.choice((1, 1, 2, 4, 8)))
        if rng.random() < 0.12:  # an article may say what furniture says, or a single word
            text = rng.choice((*NOTICES, "All rights reserved.", rng.choice(LABELS), *_words(rng, 4)))
        kind = rng.random()
        if kind < 0.55:
            return f"<p>{text}</p>"
        if kind < 0.65:
            return f"<p><b>{text}<br>"
        if kind < 0.72:
            return f'<p>{text} <a href="/l">{" ".join(_words(rng, 3))}</a> {_sentences(rng, 1)}</p>'
        if kind < 0.78:
            return self.heading(rng.randint(1, 7))
        if kind < 0.83:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.89:
            return "<ul>" + "".join(f"<li>{_sentences(rng, 1)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.92:
            return f"<pre>{text}\n  x = 1;</pre>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{_words(rng, 1)[0]}<td>{rng.randint(1, 99)}" for _ in range(3)) + "</table>"
        if kind < 0.97:
            return f'<figure><img src="/i.png"><figcaption>{_sentences(rng, 1)}</figcaption></figure>'
        return f"<div>{text}</div>"

    def article(self):
        rng = self.rng
        title = f"<h1>{' '.join(_words(rng, rng.randint(1, 9)))}</h1>"
        if rng.random() < 0.15:
            title = f"<header>{title}</header>"
        parts = [self.paragraph() for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 14, 25)))]
        inner = [self.ad, self.share, self.side, self.notice, self.form, self.form, self.comments, self.footer]
        for make in rng.sample(inner, rng.choice((0, 0, 1, 2, 4))):
            # without names only comments and footers behind the text can be told
            parts.insert(rng.randint(0, len(parts)) if make not in (self.comments, self.footer) else len(parts), make())
        inside = (title if rng.random() < 0.85 or not parts else "") + "".join(parts)
        kind = rng.random()
        if kind < 0.4:
            inside = f"<article{_mark(True)}>{inside}</article>"
        elif kind < 0.5:
            inside = f"<main{_mark(True)}>{inside}</main>"
        elif kind < 0.6:
            inside = f"<main><article{_mark(True)}>{inside}</article></main>"
        elif kind < 0.85:
            name = rng.choice(NAMES["main"])
            inside = f'<div {rng.choice(("class", "id"))}="{name}"{_mark(True)}>{inside}</div>'
        elif kind < 0.9:
            inside = f'<table><tr><td class="{rng.choice(NAMES["main"])}"{_mark(True)}>{inside}</td></tr></table>'
        elif kind < 0.95:
            inside = f'<section{self.name("main")}{_mark(True)}>{inside}</section>'
        else:
            inside = f"<div{_mark(True)}>{inside}</div>"
        return f'<div class="{rng.choice(("wrapper", "container", "page", "row", "site"))}">{inside}</div>' if rng.random() < 0.3 else inside

    def page(self):
        rng = self.rng
        if rng.random() < 0.05:  # an article and nothing else, a whole page or a mere fragment
            inside = "".join(self.paragraph() for _ in range(rng.randint(1, 6)))
            return rng.choice(("<html><body{}>{}</body></html>", "<div{}>{}</div>", "<article{}>{}</article>")).format(_mark(True), inside)
        before = [make() for make in (self.notice, self.header, self.menu, self.ad, self.form, self.side) if rng.random() < 0.4]
        after = [make() for make in (self.share, self.comments, self.side, self.ad, self.menu, self.notice, self.form) if rng.random() < 0.25]
        if rng.random() < 0.8:
            after.append(self.footer())
        head = f"<head><meta charset=utf-8><title>{_words(rng, 1)[0]}</title><style>p{{}}</style><script>var x='<p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{self.article()}{''.join(after)}</body></html>"


def labelled_page(seed):
    """The labelled page of a number."""
    return _Writer(random.Random(seed)).page()
