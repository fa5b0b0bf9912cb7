"""Labelled pages for the page model.

``data-y`` marks an element and what it holds as content (1) or not (0); elements
without a mark take their parent's, and a page starts as not content. Pages are
put together from layouts and parts by a counter, so that each part meets each
layout.
"""

from __future__ import annotations

_WORDS = "the river was low that summer and people from both banks walked across it on stones to trade salt for grain while boats lay idle".split()


def _sentence(seed: int, words: int) -> str:
    picked = [_WORDS[(seed * 7 + i * (seed % 5 + 3)) % len(_WORDS)] for i in range(words)]
    return " ".join(picked).capitalize() + "."


def _paragraphs(seed: int, count: int, closed: bool = True) -> str:
    out = []
    for i in range(count):
        body = " ".join(_sentence(seed + 3 * i + j, 5 + (seed + i + j) % 17) for j in range(1 + (seed + i) % 4))
        if (seed + i) % 6 == 0:  # junk: words over and over, no end of a sentence
            body = " ".join([_WORDS[(seed + i) % 20].capitalize() + ","] * (4 + 17 * (seed % 7)))
        elif (seed + i) % 6 == 3:
            body = _sentence(seed + i, 1 + seed % 9)[:-1]
        out.append(f"<p>{body}" + ("</p>" if closed else ""))
    return "".join(out)


def _links(seed: int, count: int, tag: str = "li") -> str:
    return "".join(f'<{tag}><a href="/{i}">{_WORDS[(seed + i) % len(_WORDS)]}</a></{tag}>' for i in range(count))


def _article(seed: int) -> str:
    """The inside of an article: heading, paragraphs, now and then lists, quotes, tables, and parts that don't belong."""
    head = f"<h1>{_sentence(seed, 7)[:-1]}</h1>" if seed % 4 else f"<header><h1>{_sentence(seed, 6)[:-1]}</h1></header>"
    parts = [head, _paragraphs(seed, 1 + seed % 3, closed=seed % 5 != 0)]
    extra = seed % 11
    if extra == 0:
        parts.append(f"<h2>{_sentence(seed + 1, 4)[:-1]}</h2><ul>" + "".join(f"<li>{_sentence(seed + i, 9)}</li>" for i in range(3)) + "</ul>")
    elif extra == 1:
        parts.append(f"<blockquote><p>{_sentence(seed, 12)}</p></blockquote>")
    elif extra == 2:
        parts.append(f"<table><tr><th>{_WORDS[seed % 20]}</th><th>{_WORDS[seed % 17]}</th></tr><tr><td>{_sentence(seed, 4)}</td><td>{_sentence(seed, 6)}</td></tr></table>")
    elif extra == 3:
        parts.append(f'<div class="ad" data-y="0">{_sentence(seed, 8)}</div>')
    elif extra == 4:
        parts.append(f'<aside class="related" data-y="0"><h3>Related</h3><ul>{_links(seed, 4)}</ul></aside>')
    elif extra == 5:
        parts.append(f'<div class="share social" data-y="0"><ul>{_links(seed, 3)}</ul></div>')
    elif extra == 6:
        parts.append(f"<section><h2>{_sentence(seed, 3)[:-1]}</h2>{_paragraphs(seed + 9, 2)}</section>")
    elif extra == 7:
        parts.append(f"<pre>{_sentence(seed, 6)}\n  {_sentence(seed, 4)}</pre><figure><figcaption>{_sentence(seed, 8)}</figcaption></figure>")
    elif extra == 8:
        parts.append(f'<form class="newsletter signup" data-y="0"><p>{_sentence(seed, 9)}</p><button>Go</button></form>')
    elif extra == 9:
        parts.append(f"<ol>" + "".join(f"<li>{_sentence(seed + i, 3)[:-1]}" for i in range(4)) + f"</ol><dl><dt>{_WORDS[seed % 9]}<dd>{_sentence(seed, 5)}</dl>")
    elif extra == 10:
        parts.append("".join(f"<p>{_sentence(seed, 1 + (seed + i // 20) % 3)[: None if i % 9 else -1]}</p>" for i in range(20 + seed)))
    parts.append(_paragraphs(seed + 5, 1 + seed % 2))
    return "".join(parts)


_BODIES = (
    '<article data-y="1">{}</article>',
    '<main data-y="1">{}</main>',
    '<main><article class="post" data-y="1">{}</article></main>',
    '<div class="content" data-y="1">{}</div>',
    '<div id="wrapper"><div id="main-content" class="article-body" data-y="1">{}</div></div>',
    '<section class="entry post" data-y="1">{}</section>',
    '<div class="container"><div class="row"><div class="story text" data-y="1">{}</div></div></div>',
    '<div><div data-y="1">{}</div></div>',
    '<table><tr><td data-y="1">{}</td></tr></table>',
)


def _before(seed: int) -> list[str]:
    return [
        f"<nav><ul>{_links(seed, 5)}</ul></nav>",
        f'<header class="site-header"><h2>{_WORDS[seed % 19]}</h2><p>{_sentence(seed, 4)}</p></header>',
        f'<div id="menu" class="navbar">{_links(seed, 6, "div")}</div>',
        f'<div class="breadcrumb">{_links(seed, 3, "div")}</div>',
        f'<div class="ad banner">{_sentence(seed, 3 + seed % 12)}</div>',
        f'<div class="cookie notice consent" role="dialog"><p>{_sentence(seed, 14)}</p><button>Yes</button></div>',
        f'<div class="alert notice"><p>{_sentence(seed, 7)} {_sentence(seed + 1, 8)}</p></div>',
        f'<form class="search" action="/s"><p>{_WORDS[seed % 13]}</p><input name="q"></form>',
        f'<div class="top"><p><a href="/">{_sentence(seed, 3)}</a></p></div>',
    ]


def _after(seed: int) -> list[str]:
    comments = "".join(f'<div class="comment"><p>{_sentence(seed + i, 12)} {_sentence(seed + i + 1, 9)}</p></div>' for i in range(2))
    return [
        f"<footer>&copy; {_WORDS[seed % 11]}.example &middot; {_sentence(seed, 8)}</footer>",
        f'<aside class="sidebar"><h3>{_WORDS[seed % 15]}</h3><p>{_sentence(seed, 10)}</p><ul>{_links(seed, 4)}</ul></aside>',
        f'<div class="sidebar widget"><p>{_sentence(seed, 15)}</p><ul>{_links(seed + 2, 5)}</ul></div>',
        f'<section id="comments"><h2>Comments</h2>{comments}</section>',
        f'<div class="comments" id="respond">{comments}<form><p>{_sentence(seed, 5)}</p></form></div>',
        f'<ol class="commentlist">' + "".join(f'<li class="comment"><p>{_sentence(seed + i, 14)}</p></li>' for i in range(3)) + "</ol>",
        f'<div class="related recommended"><h3>{_WORDS[seed % 7]}</h3><ul>{_links(seed, 6)}</ul></div>',
        f'<div class="ad sponsored promo"><p>{_sentence(seed, 9)}</p></div>',
        f'<div class="footer" id="bottom"><p>&copy; 2020 {_sentence(seed, 6)}</p></div>',
        f'<form class="login subscribe"><p>{_sentence(seed, 8)}</p><button>{_WORDS[seed % 5]}</button></form>',
        f'<aside><p>{_sentence(seed, 11)} {_sentence(seed + 4, 13)}</p></aside>',
    ]


def labelled_pages(count: int = 66) -> list[str]:
    out = []
    for i in range(count):
        before, after = _before(i), _after(i)
        top = "".join(before[(i * k + k) % len(before)] for k in range(1, 3 + i % 2))
        bottom = "".join(after[(i * k + 2 * k) % len(after)] for k in range(1, 3 + i % 3))
        body = _BODIES[i % len(_BODIES)].format(_article(i))
        out.append(f"<!DOCTYPE html><html><head><title>{_sentence(i, 5)}</title><style>p{{}}</style></head><body>{top}{body}{bottom}</body></html>")
    return out
