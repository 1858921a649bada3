"""Plain versions of steps, row by row, for the tests to compare with."""

import collections
import math
import re
import struct

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def chained(*values):
    """The engine's 64-bit hash of a row of values: each is hashed with the hash of those before as its seed, nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, Int) else "<q", v), seed=h)
    return h - 2**64 if h >= 2**63 else h


class Int(int):
    """A number of 32 bits."""


def exponent(tokens, entropy_share, max_repeats, budget):
    """The greater of the least exponents that meet the targets, found by halving, in steps of 32**-6."""
    total = sum(tokens)
    share = [x / total for x in tokens]
    if len(share) < 2:
        return 1.0

    def least(fits):
        if fits(0.0):
            return 0.0
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if fits(mid) else (mid, hi)
        return math.ceil(hi * 32**6 - 1e-3) / 32**6

    def weights(t):
        z = sum(s**t for s in share)
        return [s**t / z for s in share]

    bounds = []
    if entropy_share is not None:
        bounds.append(least(lambda t: -sum(w * math.log(w) for w in weights(t)) < entropy_share * math.log(len(share))))
    if max_repeats is not None:
        bounds.append(least(lambda t: max(w * budget / x for w, x in zip(weights(t), tokens)) <= max_repeats))
    return max(bounds, default=1.0)


def copies(rows, entropy_share, max_repeats, budget=None, seed=17, block_tokens=100_000, max_blocks=4096):
    """How often each row (doc_id, text, source) is taken."""
    rows = [(d, len(WORD.findall(t or "")), s or "") for d, t, s in rows]
    marks = [chained(Int(seed), d, n) for d, n, _ in rows]
    tokens = collections.Counter()
    for _, n, s in rows:
        tokens[s] += n
    full = {s: n for s, n in tokens.items() if n}
    budget = float(sum(full.values()) if budget is None else budget)
    t = exponent(list(full.values()), entropy_share, max_repeats, budget) if full else 1.0
    total = sum(full.values())
    z = sum((n / total) ** t for n in full.values())
    out = [1] * len(rows)
    for s, n in full.items():
        wanted = (n / total) ** t / z * budget
        whole = int(wanted // n)
        left = math.floor(wanted - whole * n)
        blocks = min(max_blocks, max(1, math.ceil(n / block_tokens)))
        of = [i for i, r in enumerate(rows) if r[2] == s]
        order = sorted(of, key=lambda i: (chained(Int(seed), s, chained(marks[i]) % blocks), marks[i]))
        # documents of one mark go together, and a document that doesn't fit in the cut block ends the row
        by_block = collections.defaultdict(lambda: collections.defaultdict(list))
        for i in order:
            by_block[chained(Int(seed), s, chained(marks[i]) % blocks)][marks[i]].append(i)
        extra = set()
        for block in sorted(by_block):
            size = sum(rows[i][1] for some in by_block[block].values() for i in some)
            if size <= left:
                left -= size
                extra |= {i for some in by_block[block].values() for i in some}
                continue
            for mark in sorted(by_block[block]):
                size = sum(rows[i][1] for i in by_block[block][mark])
                if size > left:
                    break
                left -= size
                extra |= set(by_block[block][mark])
            break
        for i in of:
            out[i] = whole + (i in extra)
    return out


def without_boilerplate(rows, sites=10):
    """Rows (doc_id, text, source) without the lines that different texts have on so many sites; texts that differ in white space only are one, that of the least row."""
    first = {}
    for d, t, s in rows:
        if t is not None:
            at = (d is None, d or 0, s is not None, s or "")
            key = re.sub(r"[\x20\x09-\x0D]", "", t)
            first[key] = min(first.get(key, (at, t, s)), (at, t, s), key=lambda x: x[0])
    spread = collections.defaultdict(set)
    for _, t, s in first.values():
        for line in t.split("\n"):
            if WORD.search(line):
                spread[line.strip(" \t\n\x0b\x0c\r")].add(s)
    bad = {k for k, v in spread.items() if len(v) >= sites}
    return [(d, t if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r") not in bad), s) for d, t, s in rows]


def quality(text):
    """The measures of the quality rules."""
    t = text or ""
    w = WORD.findall(t)
    n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {"words": len(w), "chars": sum(map(len, w)), "symbols": sum(c in "#*$%&|<>" for c in t), "dup": len(lines) - len(set(lines)), "repeat": len(cover), "lines": len(lines)}


def good(text):
    m = quality(text)
    return not (m["words"] < 50 or 100 * m["repeat"] > 50 * m["words"] or m["chars"] < 2 * m["words"] or m["chars"] > 15 * m["words"] or 10 * m["symbols"] > 3 * m["words"] or m["lines"] > 1 and 10 * m["dup"] > 7 * m["lines"])


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each_group(rows):
    """Rows (doc_id, text, ...) without the near copies of a row of lesser id; for rows of different ids."""
    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r[0]), r[0])
    return [r for i, r in enumerate(rows) if not sets[i] or best[find(i)] == r[0]]
