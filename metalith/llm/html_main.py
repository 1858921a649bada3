"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A linear classifier gives each block a cost of calling it
content and one of calling it boilerplate; the costs become capacities of edges to the two
terminals. Neighbouring blocks, and blocks next to each other among the children of one
element, are tied by smoothness edges. The minimum cut is the cheapest labelling,
found by augmenting paths; blocks on the source side are the main text.

The classifier is a logistic regression over what a block is (``FEATURES``): length, share of link text,
punctuation, tag, the innermost tag around it that says what it is for, what the words of classes, ids and roles around
it say (in two strengths), words of notices in its text, and how much text its container has. It is
fitted on the labelled sample pages of ``html_samples`` (``SAMPLE_PAGES`` of them), by Newton steps on the driver, and
shipped as ``WEIGHTS`` numbers; so a page's result depends on that page alone. No single feature decides: long plain prose
outweighs a class word, and a class word outweighs short prose.

Text of a block: character references decoded, white space turned into one space, trimmed.
Blocks are joined in page order by one line feed.

Defined cases: a null or empty page gives an empty text; unclosed and stray tags are
tolerated; a page without markup is one block of text; very long pages are read whole; repeated rows
each get a row; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metalith.llm import html_samples
from metalith.llm.shared import lean

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Any attribute: its name, and its value in double quotes, single quotes or none.
ANY_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MAY_HIDE = re.compile(r"hidden|display", re.I)
#: A class that shows the element again at some width or in some state.
SHOWN = re.compile(r"\S+:(?:block|flex|grid|table|contents|flow-root|inline\S*|visible)", re.I)
#: White space of HTML and other white space, but not the no-break space's own meaning: all become one space.
SPACES = re.compile(r"\s+")
WORD = re.compile(r"[A-Za-z]+")
#: A class that tells of something elsewhere on the page.
LAYOUT = re.compile(r"\b(?:has|with|no|without)[-_ ]?[A-Za-z]+", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Elements whose text is never shown as text.
SKIPPED = frozenset("script style noscript template svg annotation annotation-xml head title iframe object canvas textarea select option button audio video datalist".split())
#: Of these, elements whose content is not markup.
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var nobr math semantics mrow mi mo mn ms mtext msup msub msubsup mfrac msqrt mroot mover munder mspace mstyle".split())
#: What an element's tag says.
BAD_TAGS = frozenset("nav footer aside form menu dialog header fieldset".split())
GOOD_TAGS = frozenset("article main".split())
#: Elements of which a form is no part, but the other way round.
PAGE_PARTS = frozenset("article main nav header footer h1".split())
#: What a word of a class, id or role says, clearly or perhaps.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal newsletter subscribe subscription signup login register "
    "sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs toolbar topbar footer masthead comment comments disqus share sharing social related recommended recommendations pagination pager "
    "complementary contentinfo outbrain taboola skip shoutbox".split()
)
MAYBE_BAD_WORDS = frozenset(
    "alert overlay rail widget widgets foot header head reply replies follow recommend paging search legal copyright disclaimer tags teaser toc form announcement message messages warning feedback respond "
    "trending popular".split()
)
GOOD_WORDS = frozenset("article post story entry main body text prose articlebody maincontent content hentry".split())
#: Words of notices, as they stand in texts.
NOTICE_WORDS = re.compile(r"\b(?:cookies?|privacy|consent|accept|subscribe|newsletter|advertis\w+|preferences|tracking|policy|copyright|all rights reserved|terms of (?:use|service)|sign up|log in)\b|©", re.I)

#: Smoothness of the cut: ties of blocks in one kind of place, and across a change of it.
NEAR, SIBLING, ACROSS = 0.6, 0.6, 0.15
#: The penalty of large weights in the fit, and its Newton steps.
RIDGE, STEPS = 1.0, 12
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


class Element:
    __slots__ = ("tag", "own", "words", "skip", "parent", "_place")

    def __init__(self, tag: str, attributes: str, parent):
        self.tag, self.parent, self._place = tag, parent, None
        self.skip = tag in SKIPPED or parent is not None and parent.skip or hides(attributes)
        self.own = 0 if tag in ("html", "body") else -1 if tag in BAD_TAGS else 1 if tag in GOOD_TAGS else 0
        self.words = (0, 0, 0) if tag in ("html", "body") else words_of(attributes)
        if tag == "header":
            above = parent
            while above is not None and not above.own:
                above = above.parent
            if above is not None and above.own > 0:
                self.own = 0  # the header of an article holds its title
        if tag in PAGE_PARTS or self.own > 0 or self.words[0]:
            form = parent
            while form is not None:
                if form.tag == "form":
                    form.own = 0  # a form around the parts of a page says nothing of them
                form = form.parent

    @property
    def place(self) -> tuple[int, ...]:
        """What the elements around a text say, when the page has been read: of the innermost tag that says anything, good and bad; of the innermost words that do, good,
        bad and perhaps bad; and whether words farther out are bad, without and with a good element in between."""
        if self._place is None:
            tag = good = bad = maybe = far = past = 0
            named = between = False
            e = self
            while e is not None:
                tag = tag or e.own
                if any(e.words):
                    if not named:
                        named = True
                        good, bad, maybe = e.words
                    elif e.words[1]:
                        if between:
                            past = 1
                        else:
                            far = 1
                between = between or e.own > 0
                e = e.parent
            self._place = (int(tag > 0), int(tag < 0), good, bad, maybe, far, past)
        return self._place


def hides(attributes: str) -> bool:
    """Whether an element isn't shown: it has the attribute hidden, aria-hidden of true, or a style whose display is none. Values that only name the word hide nothing."""
    if not attributes or not MAY_HIDE.search(attributes):
        return False
    values: dict[str, str] = {}
    for m in ANY_ATTRIBUTE.finditer(attributes):
        values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # the first of equal names counts
    if "hidden" in values or values.get("aria-hidden", "").strip().lower() == "true":
        return True
    display = ""
    for declaration in values.get("style", "").lower().split(";"):
        name, _, value = declaration.partition(":")
        if name.strip() == "display" and ("!important" in value or "!important" not in display):
            display = value
    return display.replace("!important", "").strip() == "none"


def words_of(attributes: str) -> tuple[int, int, int]:
    """Whether the words of an element's attributes are good, bad and perhaps bad."""
    good = bad = maybe = 0
    if attributes and "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            words = {w.lower() for w in WORD.findall(CAMEL.sub(" ", LAYOUT.sub(" ", value)))}
            bad |= not words.isdisjoint(BAD_WORDS) or m[1].lower() == "class" and hidden_class(value)
            maybe |= not words.isdisjoint(MAYBE_BAD_WORDS)
            good |= not words.isdisjoint(GOOD_WORDS)
    return int(good), int(bad), int(maybe)


def hidden_class(value: str) -> bool:
    """Whether 'hidden' is a class of its own, which no other class takes back; overflow-hidden or hidden-print say nothing."""
    names = value.lower().split()
    return "hidden" in names and not any(SHOWN.fullmatch(n) for n in names)


class Block:
    __slots__ = ("text", "element", "links", "tag")

    def __init__(self, text: str, element: Element, links: int, tag: str):
        self.text, self.element, self.links, self.tag = text, element, links, tag


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    here = Element("html", "", None)
    at = linked = 0
    in_link = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, here, linked, here.tag))
            parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not here.skip:
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m[1] else 1
            continue
        close_block()
        if m[1]:
            in_link = 0
            e = here
            while e is not None and e.tag != tag:
                e = e.parent
            if e is not None and e.parent is not None:
                here = e.parent
        elif tag not in VOID and not m[3].endswith("/"):
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if here.tag == "p" or here.tag == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
                here = here.parent or here
            here = Element(tag, m[3], here)
    text(page[at:])
    close_block()
    return out


FEATURES = (
    "one", "log words", "words to 40", "link share", "sentence", "heading", "paragraph", "list item", "few words", "notice words", "good tag", "bad tag", "good words", "bad words", "maybe bad words",
    "far bad words", "bad words past a good tag", "log words of the container", "container's share", "bad and long", "bad tag and long",
)
WEIGHTS = len(FEATURES)


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    counts = [b.text.count(" ") + 1 for b in blocks]
    held: Counter[int] = Counter()
    for b, n in zip(blocks, counts):
        held[id(b.element.parent)] += n
    total = sum(counts)
    out = []
    for b, n in zip(blocks, counts):
        good_tag, bad_tag, good, bad, maybe, far, past = b.element.place
        most = min(n, 40) / 40
        around = held[id(b.element.parent)]
        out.append((
            1.0, math.log1p(n), most, min(1.0, b.links / max(1, len(b.text))), float(b.text[-1] in ".!?…:;\"”»)" and n > 3), float(b.tag in HEADINGS), float(b.tag in ("p", "blockquote", "pre")), float(b.tag == "li"),
            float(n <= 3), float(min(2, len(NOTICE_WORDS.findall(b.text)))) if n < 60 else 0.0, good_tag, bad_tag, good, bad, maybe, far, past, math.log1p(around), around / total, bad * most, bad_tag * most,
        ))
    return out


@functools.cache
def fitted(n: int = html_samples.SAMPLE_PAGES, seed: int = html_samples.SEED) -> tuple[float, ...]:
    """The weights of the classifier, as log-odds of being content."""
    rows, labels = [], []
    for page, said in html_samples.pages(n, seed):
        blocks = blocks_of(page)
        rows += features(blocks)
        labels += [any(w in said for w in b.text.replace(".", " ").split()) for b in blocks]
    x, y = np.array(rows), np.array(labels, float)
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (y - p) - RIDGE * w
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), slope)
    return tuple(round(float(v), 6) for v in w)


def minimum_cut(gain: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut.

    ``gain`` is a node's capacity from the source (if positive) or to the sink; ``ties``
    are undirected edges. What flows straight through a node is already taken off."""
    n = len(gain)
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in ties:
        room[a][b] = room[a].get(b, 0.0) + c
        room[b][a] = room[b].get(a, 0.0) + c
    left = list(gain)
    starts = deque(i for i in range(n) if left[i] > 0)
    reached = [False] * n
    while True:
        reached = [False] * n
        parent = [-1] * n
        queue = deque(i for i in starts if left[i] > 1e-9)
        for i in queue:
            reached[i] = True
        end = -1
        while queue and end < 0:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 1e-9 and not reached[j]:
                    reached[j] = True
                    parent[j] = i
                    if left[j] < -1e-9:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            return reached
        path = [end]
        while parent[path[-1]] >= 0:
            path.append(parent[path[-1]])
        flow = min(left[path[-1]], -left[end], *(room[path[k + 1]][path[k]] for k in range(len(path) - 1)))
        left[path[-1]] -= flow
        left[end] += flow
        for k in range(len(path) - 1):
            a, b = path[k + 1], path[k]
            room[a][b] -= flow
            room[b][a] += flow


def label(blocks: list[Block], weights: tuple[float, ...]) -> list[bool]:
    gain = [sum(f * w for f, w in zip(row, weights)) for row in features(blocks)]
    ties = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        above = id(b.element.parent)
        if i:
            before = blocks[i - 1]
            ties.append((i - 1, i, NEAR if before.element.place == b.element.place else ACROSS))
        if above in last and last[above] != i - 1:
            ties.append((last[above], i, SIBLING if blocks[last[above]].element.place == b.element.place else ACROSS))
        last[above] = i
    return minimum_cut(gain, ties)


def main_text(page: str | None, weights: tuple[float, ...] | None = None) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, kept in zip(blocks, label(blocks, weights or fitted())) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""
    weights = fitted()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    narrow = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return narrow.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
