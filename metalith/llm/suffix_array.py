"""Byte-level deduplication by blockwise suffix sorting with a difference cover.

A byte is removed if a 100-byte string that covers it also starts earlier: in a
document with a smaller id, or earlier in the same document. ``repeats`` narrows the
corpus down to runs of strings whose anchor occurs in several different runs; only
those are sorted, one group of anchors at a time:

* the group's texts are laid out in one buffer; sample positions are those whose
  residue modulo 32 lies in a difference cover, and their suffixes are ranked first
  (32-byte blocks, then two doublings: 128 bytes deep);
* suffixes are then sorted one bucket (leading byte) at a time by their first 32 bytes,
  and longer ties by the sample ranks: any two positions have a common shift below 32
  that moves both onto the sample. The texts are laid out with their anchors aligned,
  so nearly all ties share a residue and are resolved together by one shift;
* neighbours in suffix order with a common prefix of 100 bytes are compared byte by
  byte, and all but the earliest of each class are flagged.

Scratch memory is that of one bucket and the ranks, not of 13 words a suffix.

Defined cases: a null text is empty; fewer than 100 bytes lose nothing; a null doc_id
counts as the greatest; rows that share a doc_id, or have none, don't remove each other's
bytes, whether their texts are equal or not; texts are read whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metalith.llm import repeats
from metalith.llm.kernels import BYTES_1, BYTES_2, Runs, U, covered

WINDOW_BYTES = 100
GRAM_BYTES = 24
PERIOD = 32
PAD = 255
DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def difference_cover(period: int) -> np.ndarray:
    """Residues of which every difference modulo ``period`` is one of two: the first r and the multiples of r."""
    r = int(np.ceil(np.sqrt(period)))
    return np.unique(np.append(np.arange(r), np.arange(0, period, r)))


COVER = difference_cover(PERIOD)
IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: Index of a residue in the cover.
PLACE = np.cumsum(IN_COVER) - 1
#: Shift from a residue to the next one in the cover.
NEXT = np.array([next(d for d in range(PERIOD) if IN_COVER[(r + d) % PERIOD]) for r in range(PERIOD)])
#: Common shift of two residues onto the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if IN_COVER[(a + d) % PERIOD] and IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


def word_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as a big-endian number, so numbers sort as bytes do."""
    out = np.zeros(len(at), U)
    for i in range(8):
        out = (out << U(8)) | text[at + i].astype(U)
    return out


def dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows by their keys, first key first; equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(repeats.heads(*[k[order] for k in keys]))
    return rank


class CoverRanks:
    """Ranks of the sample suffixes, 128 bytes deep."""

    def __init__(self, text: np.ndarray):
        blocks = len(text) // PERIOD - 5
        at = (np.arange(blocks)[:, None] * PERIOD + COVER[None, :]).ravel()
        rank = dense([word_at(text, at + 8 * i) for i in range(PERIOD // 8)])
        for step in (len(COVER), 2 * len(COVER)):
            later = np.zeros(len(rank), np.int64)
            later[:-step] = rank[step:]
            rank = dense([rank, later])
        self.rank = rank

    def of(self, at: np.ndarray) -> np.ndarray:
        """Rank at positions in the sample."""
        return self.rank[(at // PERIOD) * len(COVER) + PLACE[at % PERIOD]]

    def compare(self, a: int, b: int) -> int:
        """Order of two suffixes that agree on their first 32 bytes."""
        d = SHIFT[a % PERIOD, b % PERIOD]
        x, y = a + d, b + d
        return int(self.rank[(x // PERIOD) * len(COVER) + PLACE[x % PERIOD]]) - int(self.rank[(y // PERIOD) * len(COVER) + PLACE[y % PERIOD]])


def sort_bucket(text: np.ndarray, ranks: CoverRanks, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bucket of suffix positions in suffix order (to a depth of 100 bytes at least), and their groups of equal first 32 bytes."""
    keys = [word_at(text, at + 8 * i) for i in range(PERIOD // 8)]
    order = np.lexsort(keys[::-1])
    at, keys = at[order], [k[order] for k in keys]
    group = np.cumsum(repeats.heads(*keys)) - 1
    tied = (np.bincount(group) > 1)[group]
    if not tied.any():
        return at, group
    residue = at % PERIOD
    order = np.arange(len(at))
    t = np.flatnonzero(tied)
    order[t] = t[np.lexsort((ranks.of(at[t] + NEXT[residue[t]]), residue[t], group[t]))]
    at, residue = at[order], residue[order]
    mixed = np.zeros(group[-1] + 1, bool)
    same = group[1:] == group[:-1]
    mixed[group[1:][same & (residue[1:] != residue[:-1])]] = True
    if mixed.any():
        first = np.searchsorted(group, np.flatnonzero(mixed), "left")
        last = np.searchsorted(group, np.flatnonzero(mixed), "right")
        key = functools.cmp_to_key(ranks.compare)
        for lo, hi in zip(first, last):
            at[lo:hi] = sorted(at[lo:hi].tolist(), key=key)
    return at, group


def equal_windows(text: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """True where a suffix shares its first 100 bytes with the one before it."""
    out = np.zeros(len(at), bool)
    near = np.flatnonzero(group[1:] == group[:-1]) + 1
    for i in [*range(PERIOD, WINDOW_BYTES - 8, 8), WINDOW_BYTES - 8]:
        near = near[word_at(text, at[near] + i) == word_at(text, at[near - 1] + i)]
    out[near] = True
    return out


def send_texts(r: Runs, send: np.ndarray, buf: np.ndarray, did: np.ndarray, buckets: int):
    """Runs as blobs of (document, start, key, hash of the whole text, shift of the anchor, length) and text."""
    bucket = (r.anchor[send] % U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    send, did, bucket = send[order], did[order], bucket[order]
    shift = r.place[send] - r.start[send]
    length = r.length[send] + WINDOW_BYTES - 1
    start = r.start[send] - r.start_of_row(send)
    whole = repeats.texts_of(r)[send]
    cut = np.append(np.flatnonzero(repeats.heads(bucket)), len(bucket))
    for lo, hi in zip(cut[:-1], cut[1:]):
        body = b"".join(buf[s : s + n].tobytes() for s, n in zip(r.start[send[lo:hi]], length[lo:hi]))
        head = repeats.pack(np.array([hi - lo]), did[lo:hi], start[lo:hi], r.key[send[lo:hi]], whole[lo:hi], shift[lo:hi], length[lo:hi])
        yield int(bucket[lo]), repeats.TEXTS, head + body


def read_texts(blobs) -> tuple[np.ndarray, ...]:
    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        for i in range(6):
            columns[i].append(np.frombuffer(blob, U if i in (2, 3) else np.int64, n, 8 + 8 * n * i))
        columns[6].append(np.frombuffer(blob, np.uint8, -1, 8 + 48 * n))
    did, start, key, whole, shift, length, body = (np.concatenate(c) for c in columns)
    # equal rows of one document send the same occurrence
    order = np.lexsort((key, start, whole, did))
    once = np.zeros(len(order), bool)
    once[order[repeats.heads(did[order], whole[order], start[order], key[order])]] = True
    if not once.all():
        body = body[np.repeat(once, length)]
    return *(x[once] for x in (did, start, key, whole, shift, length)), body


def sort_texts(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags (document, key, offset) for windows of these texts that also start in a lesser document, and, under the text's own key, earlier in the same text."""
    did, start, key, whole, shift, length, body = read_texts(blobs)
    room = (length + 2 * PERIOD - 1) // PERIOD * PERIOD
    base = np.cumsum(room) - room + (-shift) % PERIOD
    text = np.full(int(room.sum()) + 10 * PERIOD, PAD, np.uint8)
    text[np.repeat(base - (np.cumsum(length) - length), length) + np.arange(len(body))] = body
    ranks = CoverRanks(text)
    run, offset, at = repeats.run_windows(base, length - WINDOW_BYTES + 1)
    order = np.argsort(text[at], kind="stable")
    window = np.full(len(text), -1, np.int64)
    window[at] = np.arange(len(at))
    cut = np.searchsorted(text[at][order], np.arange(257))
    found, own = [], []
    for lo, hi in zip(cut[:-1], cut[1:]):
        if hi - lo > 1:
            sorted_at, group = sort_bucket(text, ranks, at[order[lo:hi]])
            same = equal_windows(text, sorted_at, group)
            if same.any():
                of = np.cumsum(~same)
                w = window[sorted_at]
                by = np.lexsort((start[run[w]] + offset[w], whole[run[w]], did[run[w]], of))
                w, of = w[by], of[by]
                d = did[run[w]]
                later = d > d[np.maximum.accumulate(np.where(repeats.heads(of), np.arange(len(w)), 0))]
                found.append(w[later])
                own.append(w[~later & ~repeats.heads(of, d, whole[run[w]])])
    w, o = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, own))
    both = np.concatenate([w, o])
    return did[run[both]], np.concatenate([key[run[w]], repeats.own_key(key[run[o]], whole[run[o]])]), offset[both].astype(np.int32)


def byte_tokens(buf: np.ndarray, offsets: np.ndarray):
    return BYTES_1[buf], BYTES_2[buf], offsets


WALKS = repeats.Walks(WINDOW_BYTES, GRAM_BYTES, byte_tokens, within=True, as_text=True)


def report(buf, offsets, row, key, at):
    drop = np.zeros(len(buf), bool)
    n = len(offsets) - 1
    if len(row):
        # only rows that have replies are walked again
        busy = np.unique(row)
        part = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in busy])
        size = np.append(0, np.cumsum(offsets[busy + 1] - offsets[busy]))
        small = buf[part]
        marks = repeats.window_flags(WALKS.runs(small, size), len(small), np.searchsorted(busy, row), key, at, True)
        drop[part] = covered(marks, WINDOW_BYTES)
    rise = drop.copy()
    rise[1:] &= ~drop[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    rise[heads] = drop[heads]
    removed, spans = (np.append(0, np.cumsum(x)) for x in (drop, rise))
    hashes = []
    for i in range(n):
        lo, hi = offsets[i], offsets[i + 1]
        part = buf[lo:hi]
        hashes.append(hashlib.sha256((part[~drop[lo:hi]] if removed[hi] > removed[lo] else part).tobytes()).hexdigest())
    return np.diff(offsets), removed[offsets[1:]] - removed[offsets[:-1]], spans[offsets[1:]] - spans[offsets[:-1]], hashes


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and the hash of the bytes kept."""
    base, found = repeats.find_repeats(docs, WALKS, send_texts, lambda blobs: sort_texts(blobs))
    return repeats.apply_report(base, found, WALKS, report, ARROW, DDL)
