"""Which windows of a corpus also start earlier: what the two substring operators share.

Windows are spans of a fixed number of tokens (13 words, or 100 bytes). The corpus'
de Bruijn graph has an edge per distinct window; a document is a walk in it. The graph
is never built edge by edge. Each window has an anchor, the least hash of the short
grams in it, and consecutive windows with one anchor form a run, a nonbranching path
by construction. Equal windows have equal anchors, so the runs with one anchor hold
all copies of their windows:

1. *Compaction.* Every document sends (anchor, run identity) pairs, once per chunk of
   documents; runs with one identity collapse into one path with its least document.
   Later copies are repeated throughout (FULL).
2. *Branching.* An anchor with several paths is where paths fork. Only the least copy of
   each such path is taken apart (SPLIT into edges, or SEND as text for suffix sorting).
3. Source coordinates (document, run, offset) carry the answers back, where flagged
   windows are united into long spans in the document itself.

``collapse`` is step 1, for both; ``substrings`` goes on with a graph of its own, ``suffix_array`` with the rest of this module.

Skew: a passage in a third of all documents is one (anchor, identity) pair, sent once
per chunk; its later copies are settled inside the chunk. An anchor with more than
``hot`` different paths in a chunk isn't sent path by path: it sends one mark, and
its paths are split into edges, which again collapse per chunk. So no group holds more
than ``hot`` rows per chunk, and nothing is dropped.

Identities are 128 bits (anchor and run hash; two hashes of an edge).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metalith.llm.kernels import Runs, U, mix, run_windows, slices, span_hash
from metalith.llm.shared import lean, settle, shuffle_width

FULL, SELF, SEND, SPLIT = 0, 1, 2, 3
#: Output batches: rows of (document, key, kind, a lesser document that has the run, or the document itself).
REPLY = "did long, key long, kind int, first long"
REPLY_ARROW = pa.schema([("did", pa.int64()), ("key", pa.int64()), ("kind", pa.int32()), ("first", pa.int64())])


@dataclass(frozen=True)
class Walks:
    """How documents become tokens, and what counts as earlier."""

    size: int
    gram: int
    #: bytes and row offsets to (tokens, second values or None, first token per row)
    tokens: Callable
    #: a later start in the same text counts as a repeat
    within: bool
    #: sort forks of cold anchors as text
    as_text: bool
    #: an anchor with more different paths than this in a chunk sends one mark, and its paths are taken apart; the result is the same
    hot: int = 64
    #: runs or edges of a chunk
    chunk: int = 500_000

    def runs(self, buf: np.ndarray, offsets: np.ndarray) -> Runs:
        values, second, bounds = self.tokens(buf, offsets)
        return Runs(values, second, bounds, self.size, self.gram)


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blobs, *kinds) -> list[np.ndarray]:
    """Columns of concatenated blobs of equal-length arrays."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for i, k in enumerate(kinds):
            parts[i].append(np.frombuffer(blob, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]


def heads(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before in any key."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def by_bucket(bucket: np.ndarray, kind: int, *arrays: np.ndarray):
    """Rows (bucket, kind, blob)."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    arrays = [a[order] for a in arrays]
    cut = np.append(np.flatnonzero(heads(bucket)), len(bucket))
    for lo, hi in zip(cut[:-1], cut[1:]):
        if hi > lo:
            yield int(bucket[lo]), kind, pack(*[a[lo:hi] for a in arrays])


MAIL = "bucket int, kind int, payload binary"
MAIL_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
RUNS_MAIL, PASSED, EDGES, TEXTS = 0, 1, 2, 3


def mail(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.record_batch([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(MAIL_ARROW)], schema=MAIL_ARROW)


def in_parts(rows, limit: int = 16 << 20):
    """Record batches of bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size > limit:
            yield mail(held)
            held, size = [], 0
    if held:
        yield mail(held)


def replies(did, key, kind, first) -> pa.RecordBatch:
    return pa.record_batch([pa.array(did, pa.int64()), pa.array(key.view(np.int64), pa.int64()), pa.array(kind, pa.int32()), pa.array(first, pa.int64())], schema=REPLY_ARROW)


def announce(walks: Walks, buckets: int):
    """Documents (did, text) to mail: each chunk's distinct runs, and what the chunk settles itself."""

    def settle_chunk(anchor, identity, did):
        order = np.lexsort((did, identity, anchor))
        anchor, identity, did = anchor[order], identity[order], did[order]
        first = heads(anchor, identity)
        once = heads(anchor, identity, did)
        key = mix_key(anchor, identity)
        least = did[np.maximum.accumulate(np.where(first, np.arange(len(did)), 0))]
        later = once & (did > least)
        passed = [(did[later], key[later], np.full(later.sum(), FULL, np.int32), least[later])]
        if walks.within:
            again = ~once
            passed.append((did[again], key[again], np.full(again.sum(), SELF, np.int32), did[again]))
        anchor, identity, did, key = anchor[first], identity[first], did[first], key[first]
        begin = heads(anchor)
        group = np.cumsum(begin) - 1
        hot = (np.bincount(group) > walks.hot)[group] if len(group) else np.zeros(0, bool)
        passed.append((did[hot], key[hot], np.full(hot.sum(), SPLIT, np.int32), did[hot]))
        marks = anchor[hot & begin]
        cold = ~hot
        a = np.concatenate([anchor[cold], marks])
        i = np.concatenate([identity[cold], np.zeros(len(marks), U)])
        d = np.concatenate([did[cold], np.full(len(marks), np.iinfo(np.int64).min)])
        yield from in_parts(by_bucket((a % U(buckets)).astype(np.int32), RUNS_MAIL, a, i, d))
        d, k, n, f = (np.concatenate(x) for x in zip(*passed))
        if len(d):
            yield from in_parts(by_bucket((k % U(buckets)).astype(np.int32), PASSED, d, k, n, f))

    def run(batches):
        held, count = [], 0
        for batch in batches:
            did = batch.column("did").to_numpy(zero_copy_only=False)
            for lo, buf, offsets in slices(batch.column("text")):
                r = walks.runs(buf, offsets)
                held.append((r.anchor, r.identity, did[lo + r.row]))
                count += len(r.row)
                if count > walks.chunk:
                    yield from settle_chunk(*(np.concatenate(x) for x in zip(*held)))
                    held, count = [], 0
        if count:
            yield from settle_chunk(*(np.concatenate(x) for x in zip(*held)))

    return run


def texts_of(r: Runs) -> np.ndarray:
    """Per run the hash of its row's text: rows that share an id are told apart by it, and equal rows are one."""
    return span_hash(r.sums_2, r.bounds[:-1], r.bounds[1:])[r.row]


def own_key(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Key of a run for flags that hold in one text only, not in all rows of its id."""
    return mix(key ^ mix(text))


def mix_key(anchor, identity):
    return mix(anchor ^ mix(identity))


def compact(walks: Walks):
    """One bucket of mail to replies."""

    def run(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        payload = group.column("payload").to_pylist()
        out = [replies(*unpack([p for p, x in zip(payload, kinds) if x == PASSED], np.int64, U, np.int32, np.int64))]
        anchor, identity, did = unpack([p for p, x in zip(payload, kinds) if x == RUNS_MAIL], U, U, np.int64)
        payload = None
        if len(anchor):
            order = np.lexsort((did, identity, anchor))
            anchor, identity, did = anchor[order], identity[order], did[order]
            mark = did == np.iinfo(np.int64).min
            first = heads(anchor, identity)
            least = did[np.maximum.accumulate(np.where(first, np.arange(len(did)), 0))]
            key = mix_key(anchor, identity)
            full = ~mark & (did > least) & heads(anchor, identity, did)
            out.append(replies(did[full], key[full], np.full(full.sum(), FULL, np.int32), least[full]))
            group_no = np.cumsum(heads(anchor)) - 1
            paths = np.bincount(group_no, first & ~mark)[group_no]
            hot = (np.bincount(group_no, mark)[group_no] > 0) | (paths > walks.hot)
            fork = first & ~mark & (hot | (paths > 1))
            kind = np.where(hot[fork] | (not walks.as_text), SPLIT, SEND).astype(np.int32)
            out.append(replies(did[fork], key[fork], kind, did[fork]))
        return pa.Table.from_batches(out)

    return run


#: A flagged window: (document, run key, offset in the run).
FLAG = "did long, key long, at int"
FLAG_ARROW = pa.schema([("did", pa.int64()), ("key", pa.int64()), ("at", pa.int32())])


def flags(did, key, at) -> pa.RecordBatch:
    return pa.record_batch([pa.array(did, pa.int64()), pa.array(key.view(np.int64), pa.int64()), pa.array(at, pa.int32())], schema=FLAG_ARROW)


def asked(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and value of a list<struct> column."""
    column = batch.column(name)
    counts = np.diff(column.offsets.to_numpy())
    items = column.flatten()
    return np.repeat(np.arange(len(column)), counts), items.field(0).to_numpy(zero_copy_only=False).view(U), items.field(1).to_numpy(zero_copy_only=False)


def fork_out(walks: Walks, buckets: int, texts):
    """Documents with requests to mail: the edges of runs to split, the text of runs to send."""

    def settle_chunk(parts):
        h1, h2, did, text, start, key, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((start, text, did, h2, h1))
        h1, h2, did, text, start, key, at = (x[order] for x in (h1, h2, did, text, start, key, at))
        first = heads(h1, h2)
        least = did[np.maximum.accumulate(np.where(first, np.arange(len(did)), 0))]
        known = did > least
        passed = [(did[known], key[known], at[known])]
        if walks.within:
            # a text is never in two chunks, so its own repeats are all found here
            again = start > start[np.maximum.accumulate(np.where(heads(h1, h2, did, text), np.arange(len(did)), 0))]
            passed.append((did[again], own_key(key[again], text[again]), at[again]))
            known |= again
        d, k, a = (np.concatenate(x) for x in zip(*passed))
        if len(d):
            yield from in_parts(by_bucket((k % U(buckets)).astype(np.int32), PASSED, d, k, a))
        rest = ~known
        h1, h2, did, start, key, at = (x[rest] for x in (h1, h2, did, start, key, at))
        if walks.within and not heads(h1, h2, did).all():
            # rows of one id ask the same of a window at one place of a run
            order = np.lexsort((at, key, did, h2, h1))
            order = order[heads(*(x[order] for x in (h1, h2, did, key, at)))]
            h1, h2, did, start, key, at = (x[order] for x in (h1, h2, did, start, key, at))
        yield from in_parts(by_bucket((h1 % U(buckets)).astype(np.int32), EDGES, h1, h2, did, start, key, at))

    def run(batches):
        held, count = [], 0
        for batch in batches:
            did = batch.column("did").to_numpy(zero_copy_only=False)
            row, key, kind = asked(batch, "asked")
            for lo, buf, offsets in slices(batch.column("text")):
                r = walks.runs(buf, offsets)
                inside = (row >= lo) & (row < lo + len(offsets) - 1)
                at, what = match(r, row[inside] - lo, key[inside], kind[inside])
                split = at[what == SPLIT]
                no, offset, token = run_windows(r.start[split], r.length[split])
                if len(no):
                    of = split[no]
                    end = token + walks.size
                    held.append((span_hash(r.sums, token, end), span_hash(r.sums_2, token, end), did[lo + r.row[of]], texts_of(r)[of] if walks.within else np.zeros(len(of), U), (token - r.start_of_row(of)).astype(np.int64), r.key[of], offset.astype(np.int32)))
                    count += len(no)
                    if count > walks.chunk:
                        yield from settle_chunk(held)
                        held, count = [], 0
                send = at[what == SEND]
                if len(send):
                    yield from in_parts(texts(r, send, buf, did[lo + r.row[send]], buckets))
        if count:
            yield from settle_chunk(held)

    return run


def match(r: Runs, row: np.ndarray, key: np.ndarray, value: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first run of each row with each asked key, and the value asked with it; ``keys`` in place of the runs' own."""
    keys = r.key if keys is None else keys
    if not len(row) or not len(r.row):
        return np.zeros(0, np.int64), value[:0]
    order = np.lexsort((np.arange(len(r.row)), keys, r.row))
    first = order[heads(r.row[order], keys[order])]
    both = np.concatenate([r.row[first], row]), np.concatenate([keys[first], key])
    o = np.lexsort((np.arange(len(both[0])), both[1], both[0]))
    new = heads(both[0][o], both[1][o])
    lead = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
    hit = (o >= len(first)) & (lead < len(first))
    return first[lead[hit]], value[o[hit] - len(first)]


def resolve(walks: Walks, sort_texts):
    """One bucket of edges and texts to flagged windows."""

    def run(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        payload = group.column("payload").to_pylist()
        d, k, a = unpack([p for p, x in zip(payload, kinds) if x == PASSED], np.int64, U, np.int32)
        out = [flags(d, k, a)]
        h1, h2, did, start, key, at = unpack([p for p, x in zip(payload, kinds) if x == EDGES], U, U, np.int64, np.int64, U, np.int32)
        if len(h1):
            order = np.lexsort((start, did, h2, h1))
            h1, h2, did, key, at = (x[order] for x in (h1, h2, did, key, at))
            first = heads(h1, h2)
            known = did > did[np.maximum.accumulate(np.where(first, np.arange(len(did)), 0))]
            out.append(flags(did[known], key[known], at[known]))
        sent = [p for p, x in zip(payload, kinds) if x == TEXTS]
        if sent:
            out.append(flags(*sort_texts(sent)))
        return pa.Table.from_batches(out)

    return run


def window_flags(r: Runs, n: int, row: np.ndarray, key: np.ndarray, at: np.ndarray, within: bool) -> np.ndarray:
    """Flags over the tokens of a slice: windows that also start earlier. ``at`` is an offset, -1 for a whole run, -2 for nothing.

    Runs that occur again in their document take the flags of their first occurrence,
    and all of them if repeats within the document count."""
    out = np.zeros(n, bool)
    if not len(r.row):
        return out
    order = np.lexsort((np.arange(len(r.row)), r.key, r.row))
    new = heads(r.row[order], r.key[order])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    hit, what = match(r, row, key, at)
    if within:
        hit, what = (np.concatenate(x) for x in zip((hit, what), match(r, row, key, at, own_key(r.key, texts_of(r)))))
    whole = np.zeros(len(r.row), bool)
    whole[hit[what == -1]] = True
    single = what >= 0
    out[r.start[hit[single]] + what[single]] = True
    again = first != np.arange(len(first))
    if within:
        whole |= again
    else:
        whole |= whole[first]
        copies = np.flatnonzero(again & ~whole)
        no, offset, token = run_windows(r.start[copies], r.length[copies])
        out[token] |= out[r.start[first[copies[no]]] + offset]
    no, _, token = run_windows(r.start[whole], r.length[whole])
    out[token] = True
    return out


def finish(walks: Walks, report, schema: pa.Schema):
    """Documents with their flags (did, doc_id, text, found) to report rows, by ``report(buf, offsets, flags)``."""

    def run(batches):
        for batch in batches:
            row, key, at = asked(batch, "found")
            lists = []
            for lo, buf, offsets in slices(batch.column("text")):
                inside = (row >= lo) & (row < lo + len(offsets) - 1)
                lists.append(report(buf, offsets, row[inside] - lo, key[inside], at[inside]))
            columns = [np.concatenate(x) if isinstance(x[0], np.ndarray) else sum(x, []) for x in zip(*lists)] if lists else []
            if columns:
                yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]], schema=pa.schema([pa.field("doc_id", batch.column("doc_id").type), *list(schema)[1:]]))

    return run


def with_did(docs: DataFrame) -> DataFrame:
    """(did, doc_id, text): a null id counts as the greatest one."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("did"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def collapse(base: DataFrame, walks: Walks, buckets: int) -> tuple[DataFrame, DataFrame]:
    """What becomes of the runs of (did, doc_id, text): (did, key, kind, first), and per did the list ``asked`` of runs to take apart."""
    sent = base.select("did", "text").mapInArrow(lean(announce(walks, buckets)), MAIL)
    first = settle(sent.groupBy("bucket").applyInArrow(compact(walks), REPLY))
    return first, first.where(F.col("kind") >= SEND).groupBy("did").agg(F.collect_list(F.struct("key", "kind")).alias("asked"))


def find_repeats(docs: DataFrame, walks: Walks, texts=None, sort_texts=None) -> tuple[DataFrame, DataFrame]:
    """(did, doc_id, text) and, per did, the list ``found`` of (key, at) for ``finish``."""
    buckets = 4 * shuffle_width(docs.sparkSession)
    base = with_did(docs)
    first, forks = collapse(base, walks, buckets)
    edges = base.select("did", "text").join(forks.hint("shuffle_hash"), "did").mapInArrow(lean(fork_out(walks, buckets, texts)), MAIL)
    second = settle(edges.groupBy("bucket").applyInArrow(resolve(walks, sort_texts), FLAG))
    found = first.where(F.col("kind") <= SELF).select("did", "key", (-1 - F.col("kind")).cast("int").alias("at")).unionByName(second)
    return base, found.groupBy("did").agg(F.collect_list(F.struct("key", "at")).alias("found"))


def apply_report(base: DataFrame, found: DataFrame, walks: Walks, report, schema: pa.Schema, ddl: str) -> DataFrame:
    empty = F.array().cast("array<struct<key:bigint,at:int>>")
    joined = base.join(found.hint("shuffle_hash"), "did", "left").select("did", "doc_id", "text", F.coalesce("found", empty).alias("found"))
    return joined.mapInArrow(lean(finish(walks, report, schema)), ddl)
