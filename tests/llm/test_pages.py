"""Url rules and main text."""

import random

import pytest

from metalith.llm import html_main, html_samples, url_rules
from metalith.llm.queries import URL_RULES


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(r), r, v) for r, v in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG", "http://example.org/", "http://a.example.org/es/x?q=1", "http://example.org/en/12#f", "https://x.com/fr/", "https://x.com/de/a/b",
    "https://x.com?u=http://y.org/", "ftp://notexample.org/es/", "http://org/x", "http://com/de/", "http://example.org/en/1", "http://example.org/en/", "a://b://c.org/x", "http://h.com/frx/\nnew",
]


@pytest.mark.parametrize("salts", [1, 7])
def test_url_rules(spark, salts):
    r = random.Random(1)
    many = [(f"{h}/{p}", r.choice(["allow", "block"])) for h in ("org", "example.org", "a.example.org", "com") for p in ("", "e", "en", "en/", "en/1", "en/12", "es/", "f", "fr/x")]
    urls = URLS + [f"http://{h}/{p}" for h in ("example.org", "b.a.example.org", "z.com", "org") for p in ("", "e", "en/123", "en/1", "es/é", "fr/xy", "zz", "enx", "e\U0010ffff")]
    for rules in (URL_RULES, many, []):
        rows = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3])]
        got = url_rules.apply_rules(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "rule string, verdict string"), salts=salts)
        assert sorted((x["page_id"], x["host"], x["path"], x["rule"] or "", x["verdict"]) for x in got.collect()) == sorted((i, h, p, rule or "", v) for i, u in rows for h, p, rule, v in [plain(u, rules)])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice">We use cookies here, as everybody does.</div>
<div id="content"><h1>A &amp; B</h1><p>First  <b>bold</b>
 words &lt;here&gt;.<p>Short<br>lines</div><!-- no --><aside><p>Other stories that look like full sentences to you.</p></aside>
<section id="comments"><p>What a great article this is, thank you very much indeed.</p></section><form><p>Your mail address, please.</p><input name=a></form><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    assert html_main.main_text(PAGE) == "A & B\nFirst bold words <here>.\nShort\nlines"
    assert html_main.main_text(None) == html_main.main_text("") == ""
    assert html_main.main_text("just seven words of text, no markup.") == "just seven words of text, no markup."
    assert html_main.main_text("<p>unclosed <i>x</b></div>" * 3 + "<a href='") is not None


STORY = "<p>The first paragraph tells at some length what happened.</p><p>The second paragraph tells, also at length, what came of it.</p>"
TOLD = "The first paragraph tells at some length what happened.\nThe second paragraph tells, also at length, what came of it."
SHOWN = [
    'style="overflow:hidden"', 'class="overflow-hidden"', 'aria-hidden="false"', 'class="hidden-print"', 'data-title="Hidden gems"', 'id="hidden-gems"', "class='story hidden-xs'", 'data-hidden="true"',
    'style="display: none; display: block"', 'data-style="display:none"', 'title="a display:none primer"', 'class="hidden md:block"', 'style="visibility:visible; --display:none"',
]
UNSEEN = ["hidden", 'hidden=""', "HIDDEN='until-found'", 'class="x" hidden', 'aria-hidden="true"', "aria-hidden=TRUE", 'style="color:red; Display : None !important"', "style=display:none"]


@pytest.mark.parametrize("tag", ["body", "div", "article"])
def test_hidden_elements(tag):
    """Only what hides an element skips it; naming the word doesn't, for the classifier neither."""
    for attributes in SHOWN:
        assert html_main.main_text(f"<html><{tag} {attributes}>{STORY}</{tag}></html>") == TOLD, attributes
    for attributes in UNSEEN:
        assert html_main.main_text(f"<html><{tag} {attributes}>{STORY}</{tag}></html>") == "", attributes


@pytest.mark.parametrize("around", ['<article class="card overflow-hidden">{}</article>', '<div class="message-body">{}</div>', '<div class="post-tags-wrapper">{}</div>', "{}", '<div title="the hidden truth">{}</div>', '<article class="promo">{}</article>', '<main class="comment-free">{}</main>'])
def test_no_word_of_a_class_decides_alone(around):
    assert html_main.main_text("<html><body>" + around.format(STORY) + "</body></html>") == TOLD


def test_hand_labelled_pages():
    """A page of two short paragraphs; an unmarked paragraph of consent; mathematics in a text; comments in clean wrappers."""
    assert html_main.main_text("<html><body><p>Two short words.</p><p>Another short one.</p></body></html>") == "Two short words.\nAnother short one."
    assert html_main.main_text(f"<article>{STORY}</article><div><p>We use cookies and ask for your consent to our privacy policy.</p></div>") == TOLD
    assert html_main.main_text(f"<article><p>Here x is <math><mi>x</mi><mo>+</mo><mn>1</mn></math> and that is all there is to say.</p>{STORY}</article>") == "Here x is x+1 and that is all there is to say.\n" + TOLD
    assert html_main.main_text(f"<article>{STORY}</article><section id='comments'><div class='entry'>{STORY.replace('paragraph', 'reader')}</div></section>") == TOLD
    assert html_main.main_text(f"<main>{STORY}</main><aside>{STORY.replace('paragraph', 'box')}</aside><footer><p>All that stands below the line, {'in many words ' * 9}.</p></footer>") == TOLD


def held_out():
    return html_samples.pages(300, seed=html_samples.SEED + 1)


def wanted(blocks, said):
    return [any(w in said for w in b.text.replace(".", " ").split()) for b in blocks]


def test_held_out_accuracy():
    right = total = 0
    for page, said in held_out():
        blocks = html_main.blocks_of(page)
        right += sum(a == b for a, b in zip(html_main.label(blocks, html_main.fitted()), wanted(blocks, said)))
        total += len(blocks)
    assert right / total >= 0.975


def test_labels_are_a_least_cut_of_the_page():
    """Against the cheapest of all labellings, with the costs and ties written out again."""
    weights, seen = html_main.fitted(), 0
    for page, _ in held_out():
        blocks = html_main.blocks_of(page)
        if not 1 < len(blocks) <= 9:
            continue
        gain = [sum(f * w for f, w in zip(row, weights)) for row in html_main.features(blocks)]
        ties = [(i - 1, i, html_main.NEAR) for i in range(1, len(blocks))]
        for i, b in enumerate(blocks):
            j = next((j for j in range(i - 1, -1, -1) if blocks[j].element.parent is b.element.parent), None)
            if j is not None and j != i - 1:
                ties.append((j, i, html_main.SIBLING))
        ties = [(i, j, c if blocks[i].element.place == blocks[j].element.place else html_main.ACROSS) for i, j, c in ties]

        def cost(side):
            return sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gain, side)) + sum(c for a, b, c in ties if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(len(blocks))]) for m in range(1 << len(blocks)))
        assert abs(cost(html_main.label(blocks, weights)) - best) < 1e-9
        seen += 1
    assert seen > 50


def test_minimum_cut_is_least():
    r = random.Random(2)
    for _ in range(60):
        n = r.randrange(1, 8)
        gain = [r.uniform(-2, 2) for _ in range(n)]
        ties = [(i, j, r.uniform(0, 1)) for i in range(n) for j in range(i) if r.random() < 0.5]

        def cost(side):
            return sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gain, side)) + sum(c for a, b, c in ties if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_main.minimum_cut(gain, ties)) - best) < 1e-9


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id long, url string, html string").selectExpr("*", "1 AS text")
    rows = sorted((r["page_id"], r["n_chars"], len(r["text"])) for r in html_main.extract(pages).collect())
    assert rows[0] == rows[1] and rows[2] == (2, 0, 0) and rows[0][1] == rows[0][2]
    assert html_main.extract(pages.limit(0)).count() == 0
