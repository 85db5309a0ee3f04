"""Labelled pages from which the extraction model is trained.

A page is a shell, a main container and other parts around and inside it, all drawn by a seeded generator.
Elements say by `data-main` whether the text below them is main text (1) or not (0); the nearest such
ancestor holds. Parts have telling names in several languages, names that say nothing, or none, so that
their structure has to be learnt too. `{p}`, `{s}`, `{w}` and `{a}` stand for a paragraph, a sentence, a few
words and a link; `{n}` is the part's attributes.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

# Names of parts of pages.
NAMES = {
    "main": "content main article post entry entry-content post-body post-content article-body story story-body text body-text blog-post page-content single hentry inhalt artikel contenu contenido articulo",
    "nav": "nav menu navbar navigation topnav main-menu menu-bar breadcrumb breadcrumbs pagination pager tabs skip-links languages site-nav links",
    "header": "header masthead top-bar topbar site-header banner branding logo head page-header kopf",
    "footer": "footer site-footer bottom colophon copyright legal imprint impressum foot page-footer",
    "side": "sidebar side aside widget widget-area rail secondary related recommended trending popular more-stories tags categories archive latest",
    "ad": "ad ads advert advertisement sponsored promo banner-ad sponsor werbung anzeige publicidad publicite adsbox dfp",
    "notice": "notice alert cookie cookie-banner cookie-notice consent gdpr modal popup overlay toast newsletter subscribe paywall signup hinweis aviso",
    "share": "share sharing social social-links follow toolbar tools print share-buttons actions",
    "form": "form search search-form login contact-form signup-form",
    "comments": "comments comment-list commentlist comment-section responses response replies reply discussion discussions thread respond disqus feedback reactions opinions talkback conversation reader-comments user-comments kommentare commentaires comentarios leserbriefe remarks answers reviews",
}
PLAIN = "box inner wrap wrapper block row col container section module item group panel unit area cell".split()
MAIN = (
    "<article{n}>{title}{body}</article>", "<main{n}>{title}{body}</main>", "<div{n}>{title}{body}</div>", "<section{n}>{title}{body}</section>",
    "<div{n}><div>{title}</div><div>{body}</div></div>", "<article{n}><header>{title}</header>{body}</article>", "<main><article{n}>{title}{body}</article></main>", "<table><tr><td{n}>{title}{body}</td></tr></table>",
    "<article{n}><header>{title}<p>{s}</p></header><section>{body}</section></article>", "<main{n}><div><div>{title}{body}</div></div></main>",
)
#: Articles of text that stands in its container itself, and containers for it.
BARE = ("{p}", "{p}", "{p} {p}", "{p}<br><br>{p}", "{p}<br><br>{p}<br><br>{p}", "{p}<br>{p}", "{s}<br>{p}<br>{s}", "{p} {a} {s}", "{p}<p>{p}</p>{p}", "{p}<ul><li>{s}</li><li>{s}</li></ul>{p}", "<b>{w}</b><br>{p}<br><br>{p}", "{p} {p} {p} {p}")
BARE_MAIN = (
    "<div{n}>{title}{body}</div>", "<div{n}>{body}</div>", "<div{n}>{body}</div>", "<div><div{n}>{title}{body}</div></div>", "<div><div{n}>{body}</div></div>", "<section{n}>{title}{body}</section>", "<article{n}>{title}{body}</article>", "<table><tr><td{n}>{title}{body}</td></tr></table>",
)
#: Layouts by table: cells beside the main one.
CELLS = (("nav", "<td{n}>{a}<br>{a}<br>{a}</td>"), ("nav", "<td{n}><a href='/'>{w}</a> {a} {a}</td>"), ("nav", "<td{n}>{w}<br>{w}</td>"), ("nav", "<td{n}><ul><li>{a}</li><li>{a}</li></ul></td>"), ("side", "<td{n}><h4>{w}</h4>{a}<br>{a}</td>"), ("ad", "<td{n}>{s}</td>"))
TITLES = ("<h1>{w}</h1>", "<h1>{w}</h1><h2>{w}</h2>", "<h2>{w}</h2>", "<h1>{w}</h1><p>{s}</p>", "<h1>{s}</h1>", "")
BODY = ("<p>{p}</p>", "<p>{p}</p>", "<p>{p}</p>", "<p>{p}", "<p>{s}</p>", "<p>{w}</p>", "<h2>{w}</h2><p>{p}</p>", "<h3>{w}</h3><p>{s}</p>", "<ul><li>{s}</li><li>{s}</li><li>{w}</li></ul>", "<ol><li>{w}</li><li>{s}</li></ol>", "<blockquote>{p}</blockquote>", "<blockquote><p>{s}</p></blockquote>", "<figure><figcaption>{s}</figcaption></figure>", "<pre>{s}</pre>", "<table><tr><th>{w}</th><th>{w}</th></tr><tr><td>{w}</td><td>{s}</td></tr></table>", "<div>{p}</div>", "<p>{s} {a} {s}</p>", "<p>{p} {a}</p>", "<dl><dt>{w}</dt><dd>{s}</dd></dl>", "<section><h2>{w}</h2><p>{p}</p><p>{s}</p></section>", "<h2>{w}</h2>{p}", "<ul><li>{a} {s}</li><li>{a} {w}</li></ul>")
BEFORE = (
    ("nav", "<nav{n}><ul><li>{a}</li><li>{a}</li><li>{a}</li></ul></nav>"), ("nav", "<div{n}>{a} {a} {a}</div>"), ("nav", "<div{n}><ul><li>{a}</li><li>{a}</li></ul></div>"), ("nav", "<ul{n}><li>{a}</li><li>{w}</li></ul>"), ("nav", "<nav{n}>{a} | {a} | {a}</nav>"),
    ("header", "<header{n}><h1>{w}</h1><p>{s}</p></header>"), ("header", "<header{n}><h1>{w}</h1></header>"), ("header", "<div{n}><h1>{a}</h1></div>"), ("header", "<div{n}><span>{w}</span>{a}</div>"), ("header", "<header{n}>{a}<form><input><button>{w}</button></form></header>"), ("header", "<header{n}><div>{w}</div><nav>{a} {a}</nav></header>"),
    ("ad", "<div{n}>{s}</div>"), ("ad", "<div{n}>{p}</div>"), ("ad", "<section{n}><p>{s}</p>{a}</section>"), ("notice", "<div{n}><p>{s}</p><button>{w}</button></div>"), ("notice", "<div{n}>{s}</div>"), ("notice", '<div role="alert"{n}>{s} {a}</div>'), ("form", "<form{n}><input><button>{w}</button></form>"), ("side", "<aside{n}><h3>{w}</h3><ul><li>{a}</li><li>{a}</li></ul></aside>"),
)
COMMENTS = (
    ("comments", "<section{n}><h3>{w}</h3><div><p>{p}</p></div><div><p>{s}</p></div></section>"), ("comments", "<ul{n}><li>{s}</li><li>{p}</li><li>{s}</li></ul>"), ("comments", "<ol{n}><li><b>{w}</b><p>{s}</p></li><li><b>{w}</b><p>{p}</p></li></ol>"), ("comments", "<div{n}><p>{s}</p><p>{p}</p></div>"), ("comments", "<div{n}><p>{s}</p></div>"), ("comments", "<div{n}>{p}</div>"),
    ("comments", '<div{n}><div class="item"><span>{w}</span><p>{s}</p><a href="#">{w}</a></div><div class="item"><span>{w}</span><p>{p}</p><a href="#">{w}</a></div></div>'), ("comments", "<section{n}><article><h4>{w}</h4><p>{s}</p></article><article><h4>{w}</h4><p>{s}</p></article><form><label>{w}</label><textarea></textarea></form></section>"), ("comments", "<div{n}><h4>{w}</h4><dl><dt>{w}</dt><dd>{s}</dd><dt>{w}</dt><dd>{p}</dd></dl></div>"),
)
AFTER = (
    *COMMENTS, *COMMENTS, ("footer", "<footer{n}>{s}</footer>"), ("footer", "<footer{n}>© {w} · {s}</footer>"), ("footer", "<footer{n}>&copy; {w}</footer>"), ("footer", "<footer{n}><p>{p}</p></footer>"), ("footer", "<footer{n}><nav>{a} {a}</nav><p>{s}</p></footer>"), ("footer", "<div{n}>{s}<br>{a}</div>"), ("footer", "<div{n}><p>{s}</p></div>"),
    ("side", "<div{n}><h4>{w}</h4><ul><li>{a}</li><li>{a}</li><li>{a}</li></ul></div>"), ("side", "<aside{n}><h3>{w}</h3><p>{s}</p></aside>"), ("side", "<div{n}><p>{s}</p><p>{a}</p></div>"), ("ad", "<div{n}>{s} {a}</div>"), ("notice", "<div{n}><p>{s}</p><form><label>{w}</label></form></div>"), ("notice", "<div{n}>{s}</div>"), ("share", "<div{n}>{a} {a} {a}</div>"), ("share", "<ul{n}><li>{a}</li><li>{a}</li></ul>"), ("form", "<form{n}><label>{w}</label><p>{s}</p><button>{w}</button></form>"),
)
INSIDE = (("ad", "<div{n}>{s}</div>"), ("ad", "<aside{n}><p>{s}</p></aside>"), ("share", "<div{n}>{a} {a}</div>"), ("side", "<aside{n}><h4>{w}</h4><ul><li>{a}</li><li>{a}</li></ul></aside>"), ("notice", "<div{n}><p>{s}</p><button>{w}</button></div>"), ("notice", "<div{n}>{s}</div>"))
WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name president team minute idea".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high)))


def _fill(layout: str, rng: random.Random) -> str:
    sentence = lambda: _words(rng, 3, 14).capitalize() + "."
    makers = {"{p}": lambda: " ".join(sentence() for _ in range(rng.randint(1, 7))), "{s}": sentence, "{w}": lambda: _words(rng, 1, 5).capitalize(), "{a}": lambda: f'<a href="/x">{_words(rng, 1, 3)}</a>'}
    for mark, make in makers.items():
        while mark in layout:
            layout = layout.replace(mark, make(), 1)
    return layout


def _named(kind: str, layout: str, rng: random.Random, plain: float, main: int | None) -> str:
    """A part with its attributes: a telling name, one that says nothing (with the given chance), or none where the tag tells."""
    shown = rng.choice(PLAIN) if rng.random() < plain else rng.choice(NAMES[kind].split())
    if rng.random() < 0.2:
        shown += " " + rng.choice(PLAIN)
    bare = not layout.startswith(("<div", "<ul", "<ol", "<section", "<table")) and rng.random() < 0.5
    names = "" if bare else f' {rng.choice(("class", "class", "class", "id"))}="{shown}"'
    return layout.replace("{n}", names + ("" if main is None else f' data-main="{main}"'), 1)


def _page(rng: random.Random) -> str:
    if rng.random() < 0.05:  # nothing but an article
        return f'<html><body data-main="1">{_fill(rng.choice(("<p>{p}</p><p>{s}</p>", "{p}", "<h1>{w}</h1><p>{p}</p><p>{p}</p>", "{p}<p>{p}", "<div>{p}</div><div>{s}</div>")), rng)}</body></html>'
    nameless = rng.random() < 0.3  # the main container, so that it isn't known by its name alone
    bare = rng.random() < 0.3
    body = [rng.choice(BARE)] if bare else [rng.choice(BODY) for _ in range(rng.choice((1, 2, 3, 4, 5, 6, 8, 12)))]
    for kind, part in rng.sample(INSIDE, rng.choice((0, 0, 1, 2))):
        body.insert(rng.randint(1, len(body)), _named(kind, part, rng, 0.0, 0))
    if rng.random() < 0.4:
        body.append(_named(*rng.choice(COMMENTS), rng, 0.0, 0))
    main = _named("main", rng.choice(BARE_MAIN if bare else MAIN), rng, 1.0 if nameless else 0.1, 1).replace("{title}", rng.choice(TITLES)).replace("{body}", "".join(body))
    before = [_named(k, x, rng, 0.15, None) for k, x in rng.sample(BEFORE, rng.choice((0, 1, 2, 3, 4)))]
    after = [_named(k, x, rng, 0.15, None) for k, x in rng.sample(AFTER, rng.choice((0, 1, 2, 3, 4)))]
    if rng.random() < 0.08:  # cells of one row
        cell = main[main.index("<td") : main.index("</td>") + 5] if main.startswith("<table><tr><td") else f"<td>{main}</td>"
        beside = [_named(k, x, rng, 0.5, 0) for k, x in rng.sample(CELLS, rng.choice((1, 1, 2)))]
        main = f"<table><tr>{''.join([*beside, cell])}</tr></table>" if rng.random() < 0.7 else f"<table><tr>{''.join([cell, *beside])}</tr></table>"
    page = "".join([*before, main, *after])
    for _ in range(rng.choice((0, 0, 1, 2))):
        page = f'<div class="{rng.choice(PLAIN)}">{page}</div>'
    return f'<!DOCTYPE html><html><head><title>{_words(rng, 2, 4)}</title></head><body data-main="0">{_fill(page, rng)}</body></html>'


def labelled_pages(n: int = 500, seed: int = 1) -> Iterator[str]:
    rng = random.Random(seed)
    for _ in range(n):
        yield _page(rng)
