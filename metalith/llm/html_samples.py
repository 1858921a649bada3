"""Labelled sample pages for the block classifier of ``html_main``, made from a rule.

A page is a row of parts: content parts in one wrapper, boilerplate parts around and inside it. Texts are
random words, so that only structure, length and the words of notices can be learnt. ``pages`` gives
(html, texts that are content); the number of pages is the bound of the sample.
"""

from __future__ import annotations

import random

SAMPLE_PAGES = 600
SEED = 5

#: What may stand around the content; {} is the place of the parts.
AROUND = [
    "<article>{}</article>", "<main>{}</main>", "<div id='content'>{}</div>", "<div class='post-content'>{}</div>", "<div class='entry'>{}</div>", "<div class='message-body'>{}</div>",
    "<div class='post-tags-wrapper'>{}</div>", "<div>{}</div>", "{}", "<section>{}</section>", "<table><tr><td>{}</td></tr></table>", "<article class='card overflow-hidden'>{}</article>",
    "<div class='story'>{}</div>", "<form><main>{}</main></form>", "<div class='page sidebar-layout'><main>{}</main></div>", "<article class='message'>{}</article>", "<div class='header-offset'><div>{}</div></div>",
    "<div class='search-result-page'>{}</div>", "<article class='post promo'>{}</article>", "<div itemprop='articleBody'>{}</div>", "<div class='forms'><article>{}</article></div>",
]
#: Parts of the content; {s}, {m} and {l} are a short, a middling and a long text.
CONTENT = ["<p>{l}.</p>", "<p>{l}.</p><p>{l}?</p>", "<p>{m}.</p>", "<p>{m}.</p><p>{m}!</p>", "<h2>{s}</h2><p>{l}.</p>", "<ul><li>{m}.</li><li>{m}</li></ul>", "<blockquote>{m}.</blockquote>", "<pre>{m}</pre>", "<p>{l} <a href=x>{s}</a> {m}.</p>", "<div>{l}.</div>", "<p>{s}</p>"]
#: Parts that are boilerplate.
OTHER = [
    "<nav><ul><li><a href=x>{s}</a></li><li><a href=x>{s}</a></li><li><a href=x>{s}</a></li></ul></nav>", "<div class='menu'><a href=x>{s}</a><p><a href=x>{s}</a></p></div>", "<header><a href=x>{s}</a></header>", "<header><p>{s}</p></header>",
    "<footer>© {s}</footer>", "<footer><p>{m}.</p></footer>", "<aside><p>{l}.</p><p>{m}.</p></aside>", "<div class='sidebar'><h3>{s}</h3><p>{m}.</p></div>", "<div class='ad'>{m}.</div>", "<div class='ad-slot'><p>{l}.</p></div>",
    "<div id='cookie-banner'><p>{n}.</p></div>", "<div><p>{n}.</p></div>", "<div>{n}.</div>", "<p>{n}.</p>", "<section id='comments'><p>{l}.</p><p>{m}!</p></section>", "<div class='comment-list'><div class='comment'><p>{l}.</p></div></div>",
    "<div class='comments'><div class='entry'><p>{m}.</p></div><div class='entry'><p>{l}.</p></div></div>", "<form><p>{m}.</p><input name=a></form>", "<div class='newsletter'><p>{m}.</p></div>", "<div class='share'>{s}</div>",
    "<div class='related'><ul><li><a href=x>{m}</a></li><li><a href=x>{m}</a></li></ul></div>", "<ul><li><a href=x>{s}</a></li><li><a href=x>{s}</a></li></ul>", "<div class='breadcrumbs'><a href=x>{s}</a> &gt; {s}</div>", "<div class='notice'><p>{m}.</p></div>",
    "<div class='widget'><p>{m}.</p></div>", "<div role='navigation'><p><a href=x>{s}</a></p></div>", "<div><a href=x>{s}</a> <a href=x>{s}</a></div>", "<p>© {s}</p>", "<dialog><p>{m}.</p></dialog>", "<div class='promo-box'><p>{m}.</p></div>",
]
#: Words that notices have.
NOTICE = "cookies privacy consent accept subscribe newsletter advertising preferences tracking policy".split()


def words(r: random.Random, lo: int, hi: int) -> str:
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(lo, hi)))


def fill(r: random.Random, part: str, said: list[str]) -> str:
    """The part with random texts, which are noted."""
    for mark, lo, hi in (("{s}", 1, 5), ("{m}", 5, 16), ("{l}", 16, 90), ("{n}", 6, 16)):
        while mark in part:
            text = words(r, lo, hi)
            if mark == "{n}":
                text = " ".join([text, *r.sample(NOTICE, 2), words(r, 1, 5)])
            said += text.split()
            part = part.replace(mark, text, 1)
    return part


def pages(n: int = SAMPLE_PAGES, seed: int = SEED):
    """(html, words of the content) of each page; words are random, so hardly any stands in both."""
    r = random.Random(seed)
    for _ in range(n):
        kept: list[str] = []
        none: list[str] = []
        parts = [fill(r, r.choice(CONTENT), kept) for _ in range(r.randrange(1, 6))]
        title = fill(r, "<h1>{s}</h1>", kept) if r.random() < 0.7 else ""
        inner = [fill(r, r.choice(OTHER), none) for _ in range(r.choice([0, 0, 0, 1]))]
        body = r.choice(AROUND).format(title + "".join(parts[:-1] + inner + parts[-1:]))
        before, after = ("".join(fill(r, r.choice(OTHER), none) for _ in range(r.randrange(0, 4))) for _ in range(2))
        yield f"<html><body>{before}{body}{after}</body></html>", set(kept) - set(none)
