"""Substring deduplication over a compacted de Bruijn graph of words.

The graph has a node per sequence of 12 words and an edge per window of 13; a document is a walk in it. A word is removed
if a window that covers it also starts in a document with a smaller id; windows are judged on the input.

1. *Walks.* Windows are cut into runs that share an anchor (a minimiser), so that equal windows lie in runs of one
   anchor. Runs with one identity collapse with their least document; later copies are repeated throughout. Only
   runs whose anchor has several identities, where the graph can fork, go on (see ``repeats``).
2. *Edges.* Each window of those becomes a row (edge, its two nodes, document, run, offset). Edges that several documents
   have are the repeated graph; nodes get their degrees in and out from it.
3. *Compaction.* Where a node has one edge in and one out, and both stand first in the same document, these are joined. Paths come from
   pointer doubling, each round a join, so a path of n edges takes log2(n) rounds. A document is told of paths, not of windows.
4. *Verification.* In source coordinates, neighbouring flagged windows with one source document unite into spans. The words of each distinct
   span are looked for in the text of its source document: as they stand, else window by window, since a span's parts may lie
   apart there. A window that isn't there, because hashes collided, is given up. So no word is removed on the word of a hash alone.

Skew: a run that stands in a third of all documents is sent once a chunk; an edge's documents and a span's texts are aggregated before
they are shuffled, and joins have a side with unique keys, so that a hot one can be split.

Defined cases: a null or empty text has no words; fewer than 13 words lose nothing;
a null doc_id counts as the greatest; rows that share a doc_id don't remove each
other's words; texts are read whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metalith.llm import repeats
from metalith.llm.kernels import BYTES_1, U, covered, prefix_sums, run_windows, slices, span_hash, split_words
from metalith.llm.shared import lean, settle, shuffle_width

WINDOW_WORDS = 13
GRAM_WORDS = 6
#: No source document: less than any id.
NOWHERE = -(2**63)
EDGE = "e1 long, e2 long, src long, dst long, did long, key long, at int"
FOUND = "array<struct<key:bigint,at:int,n:int,first:bigint>>"
REPORT = "did long, doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:bigint,words:binary>>"
SPAN = pa.struct([("first", pa.int64()), ("words", pa.binary())])
REPORT_ARROW = pa.schema([("did", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(SPAN))])


def word_tokens(buf: np.ndarray, offsets: np.ndarray):
    starts, ends, bounds = split_words(buf, offsets)
    return span_hash(prefix_sums(BYTES_1[buf]), starts, ends), None, bounds


def walks(window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> repeats.Walks:
    return repeats.Walks(window, gram, word_tokens, within=False, as_text=False)


def kept_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, drop: np.ndarray) -> bytes:
    """The words not dropped, joined by one space."""
    s, e = starts[~drop], ends[~drop]
    if not len(s):
        return b""
    steps = np.zeros(len(buf) + 2, np.int8)
    steps[s] += 1
    steps[e + 1] -= 1
    keep = np.cumsum(steps[: len(buf)], dtype=np.int8) > 0
    out = buf.copy()
    out[e[:-1]] = 32
    return out[keep].tobytes()[: int((e - s).sum()) + len(s) - 1]


def edge_rows(w: repeats.Walks):
    """Documents with the runs to take apart, to a row per window of these."""

    def run(batches):
        for batch in batches:
            did = batch.column("did").to_numpy(zero_copy_only=False)
            row, key, kind = repeats.asked(batch, "asked")
            for lo, buf, offsets in slices(batch.column("text")):
                r = w.runs(buf, offsets)
                inside = (row >= lo) & (row < lo + len(offsets) - 1)
                at, _ = repeats.match(r, row[inside] - lo, key[inside], kind[inside])
                no, offset, token = run_windows(r.start[at], r.length[at])
                end, of = token + w.size, at[no]
                hashes = (span_hash(r.sums, token, end), span_hash(r.sums_2, token, end), span_hash(r.sums, token, end - 1), span_hash(r.sums, token + 1, end))
                for part in range(0, len(no), 1 << 18):
                    cut = slice(part, part + (1 << 18))
                    columns = [h[cut].view(np.int64) for h in hashes] + [did[lo + r.row[of[cut]]], r.key[of[cut]].view(np.int64), offset[cut].astype(np.int32)]
                    yield pa.record_batch([pa.array(c) for c in columns], names=["e1", "e2", "src", "dst", "did", "key", "at"])

    return run


def paths(repeated: DataFrame) -> DataFrame:
    """(e1, e2, first, head, place) of repeated edges (e1, e2, src, dst, first): the nonbranching path of each, by the number of its first edge, and its place in it.

    An edge on a cycle without a branch is a path of its own."""
    numbered = settle(repeated.withColumn("edge", F.monotonically_increasing_id()))
    narrow = numbered.select("edge", "src", "dst", "first")
    one_in = narrow.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("before"), F.min("first").alias("first")).where("n = 1").drop("n")
    one_out = narrow.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("edge"), F.min("first").alias("first")).where("n = 1").drop("n")
    state = settle(one_out.join(one_in, ["node", "first"]).where("edge <> before").select("edge", "before", F.lit(1).cast("bigint").alias("steps")))
    done = kept = None
    while not state.isEmpty():
        # a pointer whose target has none has reached the path's first edge; those that have stay to be pointed at
        if kept is not None:
            state = state.unionByName(kept)
        ahead = state.select(F.col("edge").alias("before"), F.col("before").alias("further"), F.col("steps").alias("more"))
        moved = settle(state.join(ahead, "before", "left"))
        ended = moved.where("further IS NULL").select("edge", F.col("before").alias("head"), F.col("steps").alias("place"))
        new = ended if done is None else ended.join(done.select("edge"), "edge", "left_anti")
        if done is not None and new.isEmpty():
            break  # as long as a path is open, each round ends some of its edges: what is left are cycles
        done = settle(new if done is None else done.unionByName(new))
        kept = done.select("edge", F.col("head").alias("before"), F.col("place").alias("steps"))
        state = moved.where("further IS NOT NULL").select("edge", F.col("further").alias("before"), (F.col("steps") + F.col("more")).alias("steps"))
    if done is None:
        return numbered.select("e1", "e2", "first", F.col("edge").alias("head"), F.lit(0).cast("bigint").alias("place"))
    return numbered.join(done, "edge", "left").select("e1", "e2", "first", F.coalesce("head", "edge").alias("head"), F.coalesce("place", F.lit(0)).alias("place"))


def window_sources(r, n: int, row: np.ndarray, key: np.ndarray, at: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per token of a slice, the lesser document in which the window that starts there also starts, or ``NOWHERE``. Runs that occur again in their document take what their first occurrence has."""
    out = np.full(n, NOWHERE, np.int64)
    if not len(r.row) or not len(row):
        return out
    hit, told = repeats.match(r, row, key, np.arange(len(row)))
    for where in (at[told] < 0, at[told] >= 0):
        run, what = hit[where], told[where]
        begin = r.start[run] + np.maximum(at[what], 0)
        no, _, token = run_windows(begin, np.where(at[what] < 0, r.length[run], length[what]))
        out[token] = first[what[no]]
    order = np.lexsort((np.arange(len(r.row)), r.key, r.row))
    new = repeats.heads(r.row[order], r.key[order])
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again = np.flatnonzero(lead != np.arange(len(lead)))
    no, offset, token = run_windows(r.start[again], r.length[again])
    out[token] = out[r.start[lead[again[no]]] + offset]
    return out


def told(batch: pa.RecordBatch, name: str, fields: int) -> list[np.ndarray]:
    """Row and fields of a list<struct> column."""
    column = batch.column(name)
    items = column.flatten()
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return [row, *(items.field(i).to_numpy(zero_copy_only=False) for i in range(fields))]


def report(w: repeats.Walks):
    """Documents with what is known of their runs (``found``) to report rows and their spans; windows in ``refuted`` stay."""

    def run(batches):
        for batch in batches:
            row, key, at, length, first = told(batch, "found", 4)
            key = key.astype(np.int64).view(U)
            refuted = [{(x["first"], x["words"]) for x in some} for some in batch.column("refuted").to_pylist()]
            did, doc_id = batch.column("did"), batch.column("doc_id")
            for lo, buf, offsets in slices(batch.column("text")):
                starts, ends, bounds = split_words(buf, offsets)
                inside = (row >= lo) & (row < lo + len(offsets) - 1)
                source = np.full(len(starts), NOWHERE, np.int64)
                if inside.any():
                    source = window_sources(w.runs(buf, offsets), len(starts), row[inside] - lo, key[inside], at[inside], length[inside], first[inside])
                rows = len(offsets) - 1
                spans: list[list] = [[] for _ in range(rows)]
                for i in range(rows):
                    if refuted[lo + i]:
                        for t in bounds[i] + np.flatnonzero(source[bounds[i] : bounds[i + 1]] != NOWHERE):
                            if (int(source[t]), b" ".join(buf[starts[t] : ends[t + w.size - 1]].tobytes().split())) in refuted[lo + i]:
                                source[t] = NOWHERE
                flagged = np.flatnonzero(source != NOWHERE)
                cut = np.flatnonzero(np.append(True, (np.diff(flagged) != 1) | (source[flagged[1:]] != source[flagged[:-1]]))) if len(flagged) else flagged
                of = np.searchsorted(bounds, flagged[cut], "right") - 1
                for a, b, i in zip(cut, np.append(cut[1:], len(flagged))[: len(cut)], of):
                    head, tail = flagged[a], flagged[b - 1]
                    spans[i].append({"first": int(source[head]), "words": b" ".join(buf[starts[head] : ends[tail + w.size - 1]].tobytes().split())})
                drop = covered(source != NOWHERE, w.size)
                total = np.append(0, np.cumsum(drop))
                hashes = []
                for i in range(rows):
                    lo_word, hi_word, b = bounds[i], bounds[i + 1], offsets[i]
                    hashes.append(hashlib.sha256(kept_words(buf[b : offsets[i + 1]], starts[lo_word:hi_word] - b, ends[lo_word:hi_word] - b, drop[lo_word:hi_word])).hexdigest())
                columns = [np.diff(bounds), total[bounds[1:]] - total[bounds[:-1]], hashes, spans]
                yield pa.record_batch([did.slice(lo, rows), doc_id.slice(lo, rows), *(pa.array(c, f.type) for c, f in zip(columns, list(REPORT_ARROW)[2:]))], schema=REPORT_ARROW)

    return run


def missing(w: repeats.Walks):
    """Source documents (text, ``asked``: number and words of spans) to the windows (span, at, words) that their words don't have."""

    def run(batches):
        for batch in batches:
            lost: list[tuple] = []
            for text, some in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                whole = b" " + b" ".join(words) + b" "
                windows = None
                for x in some:
                    if b" " + x["words"] + b" " not in whole:
                        if windows is None:
                            windows = {tuple(words[i : i + w.size]) for i in range(len(words) - w.size + 1)}
                        own = x["words"].split()
                        lost += [(x["span"], i, b" ".join(own[i : i + w.size])) for i in range(len(own) - w.size + 1) if tuple(own[i : i + w.size]) not in windows]
            yield pa.record_batch([pa.array([x[k] for x in lost], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["span", "at", "words"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed and the hash of the words kept."""
    w = walks(window, min(GRAM_WORDS, window))
    base = repeats.with_did(docs)
    collapsed, forks = repeats.collapse(base, w, 4 * shuffle_width(docs.sparkSession))
    edges = settle(base.select("did", "text").join(forks.hint("shuffle_hash"), "did").mapInArrow(lean(edge_rows(w)), EDGE))
    repeated = edges.groupBy("e1", "e2").agg(F.min("did").alias("first"), F.max("did").alias("last"), F.first("src").alias("src"), F.first("dst").alias("dst")).where("first < last").drop("last")
    later = edges.select("e1", "e2", "did", "key", "at").join(paths(repeated), ["e1", "e2"]).where("did > first")
    along = later.groupBy("did", "key", "head", "first", (F.col("at") - F.col("place")).alias("shift")).agg(F.min("at").alias("at"), F.max("at").alias("to"), F.collect_set("at").alias("each"))
    whole = F.array(F.struct("at", (F.col("to") - F.col("at") + 1).alias("n")))
    parts = F.when(F.size("each") == F.col("to") - F.col("at") + 1, whole).otherwise(F.transform("each", lambda x: F.struct(x.alias("at"), F.lit(1).alias("n"))))
    on_paths = along.select("did", "key", "first", F.explode(parts).alias("p")).select("did", "key", "p.at", "p.n", "first")
    copies = collapsed.where(F.col("kind") == repeats.FULL).select("did", "key", F.lit(-1).alias("at"), F.lit(0).alias("n"), "first")
    found = settle(copies.unionByName(on_paths)).groupBy("did").agg(F.collect_list(F.struct("key", "at", "n", "first")).alias("found"))
    told_ = base.join(found.hint("shuffle_hash"), "did", "left").select("did", "doc_id", "text", F.coalesce("found", F.array().cast(FOUND)).alias("found"))
    none = F.array().cast("array<struct<first:bigint,words:binary>>")
    rows = settle(told_.withColumn("refuted", none).mapInArrow(lean(report(w)), REPORT))
    spans = settle(rows.select(F.explode("spans").alias("s")).groupBy("s.first", "s.words").agg(F.count(F.lit(1)).alias("n")).withColumn("span", F.monotonically_increasing_id()))
    asked = spans.groupBy(F.col("first").alias("did")).agg(F.collect_list(F.struct("span", "words")).alias("asked"))
    lost = settle(base.select("did", "text").join(asked.hint("shuffle_hash"), "did").select("text", "asked").mapInArrow(lean(missing(w)), "span long, at int, words binary"))
    out = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if lost.isEmpty():
        return rows.select(*out)
    # a window is refuted where none of the rows of the source's id has it
    texts = base.join(spans.select(F.col("first").alias("did")).distinct(), "did", "left_semi").groupBy(F.col("did").alias("first")).agg(F.count(F.lit(1)).alias("texts"))
    counted = lost.groupBy("span", "at").agg(F.count(F.lit(1)).alias("without"), F.first("words").alias("window"))
    false = counted.join(spans.select("span", "first", F.col("words").alias("whole")), "span").join(texts, "first").where("without = texts").select("first", "whole", "window")
    hit = rows.select("did", F.explode("spans").alias("s")).select("did", "s.first", F.col("s.words").alias("whole")).join(false, ["first", "whole"])
    refuted = settle(hit.groupBy("did").agg(F.collect_set(F.struct("first", F.col("window").alias("words"))).alias("refuted")))
    again = told_.join(refuted.hint("shuffle_hash"), "did").mapInArrow(lean(report(w)), REPORT)
    return rows.join(refuted.select("did"), "did", "left_anti").select(*out).unionByName(again.select(*out))
