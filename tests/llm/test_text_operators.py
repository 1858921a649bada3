"""Operators on whole texts against plain versions, with the awkward rows: nulls, empties, ties, repeats."""

import collections
import dataclasses
import hashlib
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from metalith.llm import bpe, line_dedup, lz_fingerprint, mixing, near_dup, quality, substrings, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def some_docs(seed, n=60):
    """Random texts with copies, shared passages, repetition and odd rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñ") for _ in range(r.randrange(1, 7))) for _ in range(40)]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    out = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 120))]
        kind = r.randrange(6)
        if kind == 0 and out:
            text = r.choice(out)[1]
        elif kind == 1:
            text = " ".join(words[:30]) + "\n" + passage + "\t" + " ".join(words[30:])
        elif kind == 2:
            text = " ".join(words[:5]) * 20
        elif kind == 3 and out and out[-1][1]:
            old = out[-1][1].split(" ")
            old[r.randrange(len(old))] = "edited"
            text = " ".join(old)
        else:
            text = "  ".join(words)
        out.append((i * 3 + 1, text))
    return out + [(1000, None), (1001, ""), (1002, "   \n\t "), (1003, "one"), (1004, "x" * 5000), (1005, "ab " * 3000)]


def plain_words_removed(rows, window=13):
    least = {}
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in docs:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, w in docs:
        drop = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                drop.update(range(i, i + window))
        out.append((d, len(w), len(drop), sha(" ".join(x for i, x in enumerate(w) if i not in drop))))
    return sorted(out)


def plain_bytes_removed(rows, window=100):
    seen, out = set(), []
    for d, t in sorted(rows):
        b = (t or "").encode()
        drop = bytearray(len(b))
        for i in range(len(b) - window + 1):
            k = b[i : i + window]
            if k in seen:
                drop[i : i + window] = b"\1" * window
            seen.add(k)
        out.append((d, len(b), sum(drop), len(re.findall(b"\1+", bytes(drop))), sha(bytes(x for x, y in zip(b, drop) if not y))))
    return out


def plain_groups(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_substrings_match_plain(documents):
    rows = some_docs(1)
    assert rows_of(substrings.remove_repeats(documents(rows))) == plain_words_removed(rows)


def test_suffixes_match_plain(documents):
    rows = some_docs(2)
    assert rows_of(suffix_array.remove_repeats(documents(rows))) == plain_bytes_removed(rows)


@pytest.mark.parametrize("limit", [2, 64])
def test_hot_anchors_are_exact(documents, monkeypatch, limit):
    from metalith.llm import repeats

    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{r.random()} {passage} {r.random()}") for i in range(80)]
    df = documents(rows)
    # the settings must hold in the functions that are shipped, so run them here
    import numpy as np
    import pyarrow as pa

    batch = pa.record_batch([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], names=["did", "text"])
    monkeypatch.setattr(substrings, "walks", lambda *a, make=substrings.walks: dataclasses.replace(make(*a), hot=limit, chunk=50))
    assert rows_of(substrings.remove_repeats(df)) == plain_words_removed(rows)
    for walks, texts, sort, report, schema, want in (
        (dataclasses.replace(suffix_array.WALKS, hot=limit, chunk=50), suffix_array.send_texts, suffix_array.sort_texts, suffix_array.report, suffix_array.ARROW, plain_bytes_removed(rows)),
    ):
        def groups(batches):
            t = pa.Table.from_batches(list(batches), schema=repeats.MAIL_ARROW)
            b = t.column("bucket").to_numpy()
            return [t.filter(pa.array(b == x)) for x in np.unique(b)]

        first = [r for g in groups(repeats.announce(walks, 4)(iter([batch]))) for r in repeats.compact(walks)(g).to_pylist()]
        asked = collections.defaultdict(list)
        for x in first:
            if x["kind"] >= repeats.SEND:
                asked[x["did"]].append({"key": x["key"], "kind": x["kind"]})
        kind = pa.list_(pa.struct([("key", pa.int64()), ("kind", pa.int32())]))
        wanted = pa.record_batch([batch.column(0), batch.column(1), pa.array([asked[d] for d, _ in rows], kind)], names=["did", "text", "asked"])
        second = [r for g in groups(repeats.fork_out(walks, 4, texts)(iter([wanted]))) for r in repeats.resolve(walks, sort)(g).to_pylist()]
        found = collections.defaultdict(list)
        for x in first:
            if x["kind"] <= repeats.SELF:
                found[x["did"]].append({"key": x["key"], "at": -1 - x["kind"]})
        for x in second:
            found[x["did"]].append({"key": x["key"], "at": x["at"]})
        flag = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())]))
        last = pa.record_batch([batch.column(0), batch.column(0), batch.column(1), pa.array([found[d] for d, _ in rows], flag)], names=["did", "doc_id", "text", "found"])
        got = [tuple(r.values()) for b in repeats.finish(walks, report, schema)(iter([last])) for r in b.to_pylist()]
        assert sorted(got) == want
    assert df.count() == 80


def test_paths_of_a_graph(spark):
    """Nonbranching paths: a line, a fork, a change of the first document, a cycle, a loop and a line behind a fork."""
    edges = [(f"{a}{b}", a, b, f) for a, b, f in [*[(i, i + 1, 7) for i in range(9)], (20, 21, 1), (21, 22, 1), (21, 23, 1), (23, 24, 1), (24, 25, 2), (40, 41, 3), (41, 40, 3), (50, 50, 3)]]
    rows = [(i, 0, a, b, f) for i, (_, a, b, f) in enumerate(edges)]
    got = {(r["e1"], r["head"], r["place"]) for r in substrings.paths(spark.createDataFrame(rows, "e1 long, e2 long, src long, dst long, first long")).collect()}
    assert len(got) == len(rows)
    by_head = collections.defaultdict(dict)
    for e, head, place in got:
        by_head[head][place] = edges[e][1:3]
    lines = sorted(tuple(p[k] for k in sorted(p)) for p in by_head.values())
    assert all(sorted(p) == list(range(len(p))) for p in by_head.values())
    assert lines == sorted([tuple((i, i + 1) for i in range(9)), ((20, 21),), ((21, 22),), ((21, 23), (23, 24)), ((24, 25),), ((40, 41),), ((41, 40),), ((50, 50),)])


def test_hashes_that_collide_remove_nothing(documents, monkeypatch):
    """With hashes that only know the length of a word, the words themselves still decide: nothing is removed that isn't repeated."""

    def weak(buf, offsets):
        import numpy as np

        from metalith.llm.kernels import split_words

        starts, ends, bounds = split_words(buf, offsets)
        return (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), None, bounds

    monkeypatch.setattr(substrings, "walks", lambda *a, make=substrings.walks: dataclasses.replace(make(*a), tokens=weak))
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(60))) for i in range(20)]
    rows += [(30, rows[3][1]), (31, rows[0][1])]
    got = rows_of(substrings.remove_repeats(documents(rows)))
    want = plain_words_removed(rows)
    assert all(g[2] <= w[2] for g, w in zip(got, want)) and all(g == w for g, w in zip(got, want) if w[2] == 0)


def test_words_of_rows_that_share_an_id(documents):
    """Rows of one id leave each other alone, whatever their texts; a null id is the greatest; parts of a span that lie apart in the source."""
    r = random.Random(19)
    a, b, c = (" ".join(f"{k}{r.randrange(10**6)}" for _ in range(60)) for k in "abc")
    half = a.split()
    apart = " ".join(half[:40]) + " x y z " + " ".join(half[28:])
    rows = [(1, a), (1, a), (1, b), (2, b), (None, c), (None, c), (None, a + " " + b), (4, apart), (5, a)]
    windows = collections.defaultdict(set)
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 12):
            windows[tuple(w[i : i + 13])].add(2**63 if d is None else d)
    want = collections.Counter()
    for d, t in rows:
        w = t.split()
        gone = {j for i in range(len(w) - 12) if min(windows[tuple(w[i : i + 13])]) < (2**63 if d is None else d) for j in range(i, i + 13)}
        want[d, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    assert collections.Counter(map(tuple, substrings.remove_repeats(documents(rows)).collect())) == want


def plain_bytes_of_rows(rows, window=100):
    """A row loses what starts earlier in it or in a row of a lesser id; no id is the greatest."""
    windows = [{t[i : i + window] for i in range(len(t) - window + 1)} for _, t in rows]
    out = []
    for d, t in rows:
        gone = set().union(*(w for w, (e, _) in zip(windows, rows) if e is not None and (d is None or e < d)))
        drop, seen = bytearray(len(t)), set()
        for i in range(len(t) - window + 1):
            k = t[i : i + window]
            if k in gone or k in seen:
                drop[i : i + window] = b"\1" * window
            seen.add(k)
        out.append((d, len(t), sum(drop), len(re.findall(b"\1+", bytes(drop))), sha("".join(x for x, y in zip(t, drop) if not y))))
    return out


@pytest.mark.parametrize("limit", [1, 64])
def test_rows_of_one_id_leave_each_other_alone(limit, monkeypatch):
    """Two equal rows and a document that shares half of them; rows without an id that share a passage at other places; a text that repeats itself beside one that doesn't."""
    monkeypatch.setattr(suffix_array, "WALKS", dataclasses.replace(suffix_array.WALKS, hot=limit))
    r = random.Random(21)
    a, b, c, d, e, f = ("".join(r.choice("abcdefghij ") for _ in range(400)) for _ in range(6))
    rows = [(1, a), (1, a), (2, "x" * 30 + a[100:300] + b[:50]), (5, c[:200] + d), (None, b), (None, b), (None, e[:77] + c[150:] + d[:130]), (None, f[:31] + e[:77] + c[150:] + f[40:90])]
    rows += [(9, e + f[:150] + a[:33] + e[90:260] + f[:20]), (9, f[:150] + a[:33] + e[90:260] + f[:20]), (9, e)]
    assert sorted(map(str, own_run(rows))) == sorted(map(str, plain_bytes_of_rows(rows)))


def own_run(rows):
    """The steps of op8 in this process, so that settings hold in them."""
    import numpy as np
    import pyarrow as pa

    from metalith.llm import repeats

    last = 2**63 - 1
    dids = [last if d is None else d for d, _ in rows]
    text = pa.array([t for _, t in rows])
    walks = suffix_array.WALKS

    def groups(batches):
        t = pa.Table.from_batches(list(batches), schema=repeats.MAIL_ARROW)
        b = t.column("bucket").to_numpy()
        return [t.filter(pa.array(b == x)) for x in np.unique(b)]

    batch = pa.record_batch([pa.array(dids), text], names=["did", "text"])
    first = [r for g in groups(repeats.announce(walks, 4)(iter([batch]))) for r in repeats.compact(walks)(g).to_pylist()]
    asked, found = collections.defaultdict(list), collections.defaultdict(list)
    for x in first:
        if x["kind"] >= repeats.SEND:
            asked[x["did"]].append({"key": x["key"], "kind": x["kind"]})
        else:
            found[x["did"]].append({"key": x["key"], "at": -1 - x["kind"]})
    wanted = pa.record_batch([batch.column(0), text, pa.array([asked[d] for d in dids], pa.list_(pa.struct([("key", pa.int64()), ("kind", pa.int32())])))], names=["did", "text", "asked"])
    for g in groups(repeats.fork_out(walks, 4, suffix_array.send_texts)(iter([wanted]))):
        for x in repeats.resolve(walks, suffix_array.sort_texts)(g).to_pylist():
            found[x["did"]].append({"key": x["key"], "at": x["at"]})
    flag = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())]))
    ids = pa.array([d for d, _ in rows], pa.int64())
    done = pa.record_batch([batch.column(0), ids, text, pa.array([found[d] for d in dids], flag)], names=["did", "doc_id", "text", "found"])
    return [tuple(r.values()) for b in repeats.finish(walks, suffix_array.report, suffix_array.ARROW)(iter([done])) for r in b.to_pylist()]


def test_difference_cover_and_order():
    import numpy as np

    d = set(suffix_array.COVER.tolist())
    assert {(a - b) % suffix_array.PERIOD for a in d for b in d} == set(range(suffix_array.PERIOD))
    r = random.Random(3)
    body = bytes(r.choice(b"ab") for _ in range(700)) * 2
    text = np.full(len(body) + 400, suffix_array.PAD, np.uint8)
    text[: len(body)] = np.frombuffer(body, np.uint8)
    ranks = suffix_array.CoverRanks(text)
    at = np.array([i for i in range(len(body) - 140) if body[i] == ord("a")])
    got, _ = suffix_array.sort_bucket(text, ranks, at)
    keys = [body[i : i + 128] for i in got.tolist()]
    assert keys == sorted(keys)


def test_near_groups_match_plain(documents):
    rows = some_docs(4)
    assert rows_of(near_dup.group_near(documents(rows)).select("doc_id", "n_shingles", "component_id", "kept")) == plain_groups(rows)


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_group_of_many_edits(documents, monkeypatch, rounds):
    """Without star rounds, all that the first stars miss is left to the prefix filter."""
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", rounds)
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        words = list(base)
        for _ in range(r.randrange(1, 12)):
            words[r.randrange(len(words))] = f"e{r.random()}"
        rows.append((i, " ".join(words)))
    assert rows_of(near_dup.group_near(documents(rows)).select("doc_id", "n_shingles", "component_id", "kept")) == plain_groups(rows)


def plain_groups_of_rows(rows):
    """Links are between texts; a row's component is the least id that its text reaches, no id being the greatest."""
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[find(i)] = find(j)
    least = collections.defaultdict(lambda: float("inf"))
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], float("inf") if d is None else d)
    return [(find(i), None if least[find(i)] == float("inf") else least[find(i)]) for i in range(len(rows))]


def rows_that_share_ids():
    r = random.Random(17)
    a, b, c, d = (" ".join(f"{k}{r.randrange(50)}" for _ in range(100)) for k in "abcd")
    near = [x + " and a few more words" for x in (a, b, c, d)]
    return [(1, a), (1, b), (3, near[1]), (2, near[0]), (None, c), (None, near[2]), (None, d), (7, near[3]), (None, "no other has this"), (5, c[:40]), (5, "one"), (6, "one"), (8, ""), (8, None), (1, a)]


def test_near_rows_that_share_an_id(documents):
    rows = rows_that_share_ids()
    got = near_dup.group_near(documents([(*x, f"s{i}") for i, x in enumerate(rows)]).withColumn("did", F.lit("x")))
    want = collections.Counter((d, c, (2**63 - 1 if d is None else d) == (2**63 - 1 if c is None else c)) for (d, _), (_, c) in zip(rows, plain_groups_of_rows(rows)))
    assert collections.Counter((x["doc_id"], x["component_id"], x["kept"]) for x in got.collect()) == want


def test_one_row_of_each_group_stays(documents):
    """Rows are dropped, not ids: a text stays though its id is that of a dropped one; near copies without an id go."""
    rows = rows_that_share_ids()
    of = [g for g, _ in plain_groups_of_rows(rows)]
    kept = near_dup.keep_one(documents([(*x, f"s{i}") for i, x in enumerate(rows)]).withColumn("rid", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "source", "rid"]
    at = sorted(int(x["source"][1:]) for x in kept.collect())
    worded = [i for i in at if rows[i][1]]
    assert len({of[i] for i in worded}) == len(worded) == len({g for g, (_, t) in zip(of, rows) if t})
    for i in worded:
        assert (rows[i][0] is None, rows[i][0] or 0) == min((rows[j][0] is None, rows[j][0] or 0) for j in range(len(rows)) if of[j] == of[i] and rows[j][1])
    assert {12, 13} <= set(at)


def test_recall_of_bands_and_estimate():
    """Pairs at the threshold and above share a band value and pass the estimate: measured against the exact similarity."""
    import numpy as np

    r = np.random.default_rng(7)
    caught = total = 0
    for _ in range(400):
        n, j = int(r.integers(20, 400)), float(r.uniform(0.75, 0.95))
        both = int(np.ceil(2 * n * j / (1 + j)))
        common, x, y = (r.integers(0, 2**63, k).astype(np.uint64) for k in (both, n - both, n - both))
        a, b = np.concatenate([common, x]), np.concatenate([common, y])
        if 100 * both < 75 * (2 * n - both):
            continue
        p, q = near_dup.registers(a), near_dup.registers(b)
        share = (p.reshape(-1, near_dup.BAND) == q.reshape(-1, near_dup.BAND)).all(axis=1).any()
        likely = near_dup.estimate(p[None], q[None], np.array([float(n)]), np.array([float(n)]))[0] >= near_dup.ESTIMATE_FLOOR
        total += 1
        caught += bool(share and likely)
    assert total > 300 and caught == total


def test_sketch_estimates_similarity():
    import numpy as np

    r = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.9):
        both = int(2000 * j / (1 + j))
        a, b = (r.integers(0, 2**63, 1000 - both).astype(np.uint64) for _ in range(2))
        c = r.integers(0, 2**63, both).astype(np.uint64)
        x, y = near_dup.registers(np.concatenate([a, c])), near_dup.registers(np.concatenate([b, c]))
        assert abs(near_dup.estimate(x[None], y[None], np.array([1000.0]), np.array([1000.0]))[0] - j) < 0.2
        assert (near_dup.merge(x, y) == near_dup.registers(np.concatenate([a, b, c]))).all()


def plain_lz(text):
    seen, w = set(), ""
    for c in text:
        w += c
        if w not in seen:
            seen.add(w)
            w = ""
    return seen | ({w} if w else set())


def test_lz_parse_and_fingerprints(documents):
    for _, t in some_docs(6):
        cuts, seen = [], set()
        lz_fingerprint.parse(t or "", 0, len(t or ""), seen, cuts)
        assert seen == plain_lz(t or "")
    rows = some_docs(7, 30)
    got = {r["doc_id"]: r for r in lz_fingerprint.fingerprint_edits(documents(rows)).collect()}
    order = sorted(rows, reverse=True)
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        own, other, next_ = (lz_fingerprint.fingerprint(x) for x in (t, edited, after))
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), sha(edited), own.tobytes().hex(), other.tobytes().hex())
        assert (r["near_edited"], r["near_next"]) == (lz_fingerprint.likeness(own, other), lz_fingerprint.likeness(own, next_))
    assert rows_of(lz_fingerprint.fingerprint_edits(documents([(5, "abc")])).select("near_next")) == [(1.0,)]


def test_lz_of_rows_that_share_an_id(documents):
    """Most rows have no id, or one id: they are dealt over several ranges, and each still meets its successor."""
    r = random.Random(27)
    rows = [(None, " ".join(r.choice("abcd") * r.randrange(1, 9) for _ in range(r.randrange(2, 30)))) for _ in range(60)] + [(5, f"five {i} " * 4) for i in range(40)] + [(9, "nine"), (1, "one"), (5, None), (None, "")]
    order = sorted(rows, key=lambda x: (-(2**63) if x[0] is None else x[0], plain.chained(x[1] or "")), reverse=True)
    want = collections.Counter()
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        want[d, len(t), sha(edited), lz_fingerprint.likeness(lz_fingerprint.fingerprint(t), lz_fingerprint.fingerprint(after))] += 1
    got = lz_fingerprint.fingerprint_edits(documents(rows))
    assert collections.Counter((x["doc_id"], x["n_chars"], x["edited_sha256"], x["near_next"]) for x in got.collect()) == want


def plain_quality(t):
    t = t or ""
    w = WORD.findall(t)
    n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality_measures(documents):
    rows = some_docs(9) + [(2000, "a #1\na #1\n\nb $ % &\n"), (2001, "x y z x y z")]
    for r in quality.quality_report(documents(rows)).collect():
        m = plain_quality(dict(rows)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        assert r["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_windows_both_ways(documents, monkeypatch):
    """Repeated windows are the same whether hashes are looked up or sorted."""
    rows = some_docs(14)
    for listed in (0, 10**6):
        monkeypatch.setattr(quality, "LISTED", listed)
        got = {r["doc_id"]: r["n_repeat_words"] for r in quality.quality_report(documents(rows)).collect()}
        assert got == {d: plain_quality(t)[4] for d, t in rows}


def test_columns_that_clash(documents):
    """Columns with the names of results or of inner columns neither break a step nor change its result."""
    rows = [(i, f"own {i}\nshared line", f"site{i}") for i in range(12)]
    names = "_bad n_lines n_removed did row body bad key line site N_Lines2 _measured n_words FAILED_BITS lines words _m0 rid group component".split()
    crowded = documents(rows).selectExpr("*", *[f"'{n}' AS {n}" for n in names])
    cleaned = line_dedup.remove_boilerplate(crowded, counts=True)
    assert cleaned.columns == [c for c in crowded.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    assert {(r["text"], r["_bad"], r["n_lines"], r["n_removed"]) for r in cleaned.collect()} == {(f"own {i}", "_bad", 2, 1) for i in range(12)}
    assert line_dedup.remove_boilerplate(crowded).columns == crowded.columns
    led = quality.ledger(crowded).collect()
    assert {(r["_measured"], r["n_words"], r["failed_bits"] & 1) for r in led} == {("_measured", 4, 1)}
    assert quality.keep_good(crowded).columns == mixing.mix(crowded).columns == near_dup.keep_one(crowded).columns == crowded.columns


def test_quality_policies(documents):
    led = quality.ledger(documents(some_docs(10)).withColumn("n_words", F.lit("clash")))
    mask = quality.policy_mask(quality.DEFAULT_POLICY)
    bits = [r["failed_bits"] & mask for r in led.collect()]
    for r in quality.ablation(led).collect():
        b = 1 << quality.BIT[r["rule"]]
        assert (r["n_failed"], r["n_failed_alone"], r["n_kept_without"]) == (sum(x & b > 0 for x in bits), sum(x == b for x in bits), sum(x & ~b == 0 for x in bits))


def test_lines(documents):
    rows = [(i, f"own {i}\n shared line \n\nrare", f"site{i % 12}") for i in range(24)] + [(100, None, "x"), (101, "", None), (102, "shared line", None), (103, "own 1\nown 1", "z")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.remove_boilerplate(documents(rows), sites=12, counts=True).collect()}
    assert got[0] == ("own 0\n", 3, 2)
    assert got[100] == (None, 0, 0) and got[101] == ("", 0, 0) and got[102] == ("", 1, 1) and got[103] == ("own 1\nown 1", 2, 0)


def test_lines_on_both_sides_of_the_threshold(documents):
    rows = [(i, "\n".join(f"on {k} sites" for k in range(1, 31) if i < k), f"site{i}") for i in range(30)]
    for sites in (3, 17, 30):
        left = "\n".join(r["text"] for r in line_dedup.remove_boilerplate(documents(rows), sites=sites).collect())
        assert {int(x.split()[1]) for x in left.split("\n") if x} == set(range(1, sites))


def test_mixture(documents):
    rows = [(i, "w " * 20, "big") for i in range(600)] + [(1000 + i, "w " * 20, "mid") for i in range(100)] + [(2000 + i, "w " * 20, "small") for i in range(10)] + [(3000, None, "none"), (3001, "", None)]
    got = mixing.copies(documents(rows), entropy_share=None, max_repeats=4.0).collect()
    by = collections.Counter()
    for r in got:
        by[r["source"]] += r["n_tokens"] * r["copies"]
    t = mixing.exponent(documents([(1, "", "")]).selectExpr("explode(array(named_struct('source', 'big', 'tokens', 12000L), named_struct('source', 'mid', 'tokens', 2000L), named_struct('source', 'small', 'tokens', 200L))) x").select("x.*"), None, 4.0)
    share = {"big": 12000 / 14200, "mid": 2000 / 14200, "small": 200 / 14200}
    z = sum(s**t for s in share.values())
    assert abs(share["small"] ** (t - 1) / z - 4.0) < 1e-3
    for s, p in share.items():
        assert abs(by[s] - 14200 * p**t / z) <= 20
    assert {r["copies"] for r in got if r["doc_id"] in (3000, 3001)} == {1}
    assert mixing.copies(documents(rows).limit(0)).count() == 0
    mixed = mixing.mix(documents(rows).withColumn("copies", F.lit(7)), entropy_share=None, max_repeats=4.0)
    assert mixed.columns == ["doc_id", "text", "source", "copies"] and mixed.count() == sum(r["copies"] for r in got)


@pytest.mark.parametrize("targets", [(0.97, 4.0), (None, 1.5), (0.6, None), (None, None)])
@pytest.mark.parametrize("budget", [None, 2500.0, 30000.0])
def test_mixture_matches_plain(documents, monkeypatch, targets, budget):
    """Each row is taken as often as a plain version says: many blocks, ids that stand twice, nulls, sources without tokens."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 300)
    r = random.Random(23)
    rows = [(i if i % 11 else i - 1, "w " * r.randrange(0, 60), r.choice(["a"] * 12 + ["b"] * 4 + ["c", None])) for i in range(400)]
    rows += [(7, "w " * 20, "a")] * 3 + [(None, "w w w", "b"), (None, None, "none"), (900, "", "none")]
    got = mixing.copies(documents(rows), budget, *targets).collect()
    want = plain.copies(rows, *targets, budget=budget, block_tokens=300)
    assert collections.Counter((x["doc_id"], x["source"], x["n_tokens"], x["copies"]) for x in got) == collections.Counter((d, s, len(WORD.findall(t or "")), n) for (d, t, s), n in zip(rows, want))


def test_entropy_target(documents):
    import math

    sources = documents([(1, "", "")]).selectExpr("explode(array(named_struct('source', 'a', 'tokens', 900L), named_struct('source', 'b', 'tokens', 90L), named_struct('source', 'c', 'tokens', 10L))) x").select("x.*")
    t = mixing.exponent(sources, 0.9, None)
    w = [x**t for x in (0.9, 0.09, 0.01)]
    w = [x / sum(w) for x in w]
    assert abs(-sum(x * math.log(x) for x in w) - 0.9 * math.log(3)) < 1e-5


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN


def test_bpe_matches_the_library(spark, documents, vocabulary):
    import base64

    import tiktoken

    path, pattern = vocabulary
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(11)
    rows = some_docs(12, 20) + [(3000, "".join(r.choice("etaoin") for _ in range(3000))), (3001, "<|endoftext|> 🎉\u00a0 x"), (3002, "ab" * 700)]
    tokenizer = bpe.Tokenizer(spark, path, pattern)
    for x in tokenizer.digests(documents(rows)).collect():
        text = dict(rows)[x["doc_id"]] or ""
        ids = own.encode_ordinary(text)
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text))
    encoded = tokenizer.encode(documents(rows))
    back = {x["doc_id"]: bytes(x["text"]).decode() for x in tokenizer.decode(encoded).collect()}
    assert back == {d: t or "" for d, t in rows}


def test_bpe_of_long_words_matches_the_library(vocabulary):
    """Words of many segments: random, periodic, of many-byte characters; a long piece and many long words."""
    import base64

    import pyarrow as pa
    import tiktoken

    path, pattern = vocabulary
    with open(path, "rb") as f:
        body = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, body.splitlines())}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Coder(body, pattern)
    r = random.Random(31)
    texts = ["".join(r.choice("etaoinshr") for _ in range(n)) for n in (63, 64, 65, 128, 129, 5000, 60000)]
    texts += [c * n for c in ("a", "abc", "the", "é", "日本") for n in (65, 1000, 7001)]
    texts += [" ".join("".join(r.choice("etaoinshr") for _ in range(240)) for _ in range(500)), " " * 999 + "\n" * 999, "".join(r.choice("é日🎉ab") for _ in range(3000))]
    ids = coder.encode(pa.array(texts))
    for text, got in zip(texts, ids):
        want = own.encode_ordinary(text)
        assert got == struct.pack(f"<{len(want)}I", *want), text[:40]
    assert [x.decode() for x in coder.decode(ids)] == texts


def test_bpe_edges(spark, documents, vocabulary, monkeypatch):
    """No rows, repeated rows, columns that clash, ids that are null or unknown, ids decoded in parts."""
    import pyarrow as pa

    tokenizer = bpe.Tokenizer(spark, *vocabulary)
    rows = [(1, "same text"), (1, "same text"), (None, None), (2, "")]
    crowded = documents(rows).selectExpr("*", "7 AS n_tokens", "'x' AS IDS", "8 AS word", "9 AS pos")
    assert tokenizer.digests(documents([])).count() == tokenizer.encode(documents([])).count() == 0
    encoded = tokenizer.encode(crowded, decoded="text")
    assert encoded.columns == ["doc_id", "source", "word", "pos", "n_tokens", "ids", "text"]
    got = sorted(tuple(x) for x in encoded.select(F.coalesce("doc_id", F.lit(-1)), "n_tokens", "text", "word").collect())
    assert got == [(-1, 0, "", 8), (1, 3, "same text", 8), (1, 3, "same text", 8), (2, 0, "", 8)]
    assert len({(x["ids_sha256"], x["decoded_sha256"]) for x in tokenizer.digests(crowded).where("doc_id = 1").collect()}) == 1
    tokens = spark.createDataFrame([(1, None), (2, []), (3, encoded.where("doc_id = 1").first()["ids"])], "doc_id long, ids array<int>")
    assert [bytes(x["text"]) for x in tokenizer.decode(tokens).orderBy("doc_id").collect()] == [b"", b"", b"same text"]
    with open(vocabulary[0], "rb") as f:
        coder_file = f.read()
    coder = bpe.Coder(coder_file, vocabulary[1])
    known = encoded.where("doc_id = 1").first()["ids"][0]
    for bad in ([known, 2**31 - 1], [2**31 - 1], [known, None]):
        with pytest.raises(ValueError):
            coder.decode(bpe.packed([bad]))
    monkeypatch.setattr(bpe, "DECODE_TOKENS", 3)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    texts = [t or "" for _, t in some_docs(13, 10)]
    ids = coder.encode(pa.array(texts))
    assert [x.decode() for x in coder.decode(ids)] == texts
    # pieces that are forgotten, kept from the older generation or learnt anew have the same ids
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    forgetful = bpe.Coder(coder_file, vocabulary[1])
    assert forgetful.encode(pa.array(texts)) == ids == forgetful.encode(pa.array(texts))


EMPTY = [
    lambda d: substrings.remove_repeats(d),
    lambda d: suffix_array.remove_repeats(d),
    lambda d: near_dup.group_near(d),
    lambda d: near_dup.keep_one(d),
    lambda d: lz_fingerprint.fingerprint_edits(d),
    lambda d: quality.quality_report(d),
    lambda d: line_dedup.remove_boilerplate(d, counts=True),
    lambda d: mixing.copies(d),
]


@pytest.mark.parametrize("operator", EMPTY)
def test_empty_tables_nulls_and_repeats(documents, operator):
    assert operator(documents([])).count() == 0
    rows = [(None, None, None), (None, "a b c", None), (1, "same text here", "s"), (1, "same text here", "s")]
    crowded = documents(rows).selectExpr("*", "1 AS did", "'x' AS key", "2 AS bucket", "'y' AS n_chars", "3 AS mark", "4 AS copies")
    assert operator(crowded).count() in (3, 4)
