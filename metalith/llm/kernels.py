"""Vectorised text kernels on Arrow buffers: words, rolling hashes, anchored runs.

Work is done in slices of about a megabyte of text, so the 64-bit scratch arrays stay
in cache and a worker's memory doesn't follow the batch size; one document is never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
SLICE_BYTES = 1 << 20
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _table(seed: int, n: int = 256) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed * 1000)) * U(0x9E3779B97F4A7C15))


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


BYTES_1, BYTES_2 = _table(1), _table(2)
POWERS = Powers(0x2545F4914F6CDD1D)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def prefix_sums(values: np.ndarray) -> np.ndarray:
    up, _ = POWERS.to(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], wherever the span lies."""
    _, down = POWERS.to(len(sums) + 1)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def slices(text: pa.Array):
    """(first row, bytes, row offsets) for slices of a string or binary column; a null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks != 1 else text.chunk(0)
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    if not (wide or pa.types.is_string(text.type) or pa.types.is_binary(text.type)):
        text, wide = text.cast(pa.string()), False
    if text.null_count:
        text = pa.compute.fill_null(text, b"" if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else "")
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, text.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def split_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (maximal runs of non-space bytes of one row), and per row the number of the first word."""
    solid = ~SPACE[buf]
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = solid[edges]
    last[edges[1:] - 1] = solid[edges[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: -(width - span)], x[width - span :]) if width > span else x


class Runs:
    """Runs of windows that share their anchor, over a slice of rows.

    ``tokens`` are 64-bit values of the words or bytes, ``bounds`` the first token of each
    row. A window is ``size`` tokens; its anchor is the ``gram``-token gram in it with the
    least hash, the leftmost of equals. Consecutive windows with the anchor in one place
    form a run. So two equal windows lie in different runs whose anchors have equal hashes,
    and have the anchor at the same shift.
    start, length: windows of the run; row; place and hash of the anchor; identity: hash of
    all tokens of the run.
    """

    def __init__(self, tokens: np.ndarray, second: np.ndarray | None, bounds: np.ndarray, size: int, gram: int):
        n, width = len(tokens), size - gram + 1
        self.size, self.bounds = size, bounds
        sums = prefix_sums(tokens)
        self.sums_2 = prefix_sums(mix(tokens + U(0x632BE59BD9B4E019)) if second is None else second)
        self.sums = sums
        counts = np.maximum(np.diff(bounds) - size + 1, 0)
        if n < size or not counts.sum():
            self.start = self.length = self.row = self.place = np.zeros(0, np.int64)
            self.anchor = self.identity = self.key = np.zeros(0, U)
            return
        _, down = POWERS.to(n + 1)
        grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        bits = U(max(21, n.bit_length()))
        least = sliding_min((grams >> bits << bits) | np.arange(len(grams), dtype=U), width)
        row = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bounds[:-1], counts)
        place = (least[at] & ((U(1) << bits) - U(1))).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = place[1:] != place[:-1]
        head = np.flatnonzero(new)
        self.start, self.row, self.place = at[head], row[head], place[head]
        self.anchor = grams[self.place]
        self.length = np.diff(np.append(head, len(at)))
        self.identity = span_hash(self.sums_2, self.start, self.start + self.length + size - 1)
        self.key = mix(self.anchor ^ mix(self.identity))

    def start_of_row(self, runs: np.ndarray) -> np.ndarray:
        return self.bounds[self.row[runs]]


def run_windows(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the given runs: run number, offset in the run, token position."""
    run = np.repeat(np.arange(len(start)), length)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length)
    return run, offset, start[run] + offset


def covered(flags: np.ndarray, size: int) -> np.ndarray:
    """Tokens covered by a flagged window; flags has one entry a token, at the window's start."""
    steps = np.zeros(len(flags) + 1, np.int64)
    at = np.flatnonzero(flags)
    steps[at] += 1
    np.subtract.at(steps, np.minimum(at + size, len(flags)), 1)
    return np.cumsum(steps[:-1]) > 0
