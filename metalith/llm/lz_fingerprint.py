"""Lempel-Ziv phrase fingerprints.

A text is parsed into LZ78 phrases: each phrase is the shortest prefix of the rest
that is not a phrase yet (the last may be one). The set of phrases is hashed, and the
fingerprint is a one-row-per-slot minimum over ``SLOTS`` multiplicative permutations of those
hashes; the share of equal slots estimates the similarity of the phrase sets, which is
high for texts that compress each other well.

``fingerprint_edits`` also fingerprints each document's edited text: its last third
replaced by the head of the next document in descending id order (the last one is
followed by the first). Documents are dealt by id ranges whose edges come from quantiles of the
ids; inside a range they stream in order, so a document meets its successor without
a window over all rows, and the text is shuffled once. Only the first document of each
range is sent twice, to the range before it as well. A document and its edit share their
first two thirds, and so does their parse.

Defined cases: a null text is empty, and an empty text has the fingerprint of the empty
set, which is alike (1.0) only to itself; a null doc_id comes last in the order; rows
that share a doc_id are ordered by a hash of the text, and dealt by it, so that no id is one task; a single document is its own successor; an
empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metalith.llm.kernels import BYTES_1, U, mix, prefix_sums, span_hash
from metalith.llm.shared import lean, shuffle_width

SLOTS = 64
_FACTORS = mix(np.arange(1, SLOTS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_SHIFTS = mix(np.arange(1, SLOTS + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F))
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def parse(text: str, start: int, limit: int, seen: set, cuts: list) -> int:
    """Continue an LZ78 parse from ``start`` with the phrases that end by ``limit``; returns where it stopped.

    Adds to the phrases and to their ends. The phrases are closed under prefixes, so the
    longest one at a place is found by walking from the length of the last."""
    k = 4
    while start < limit:
        if text[start : start + k] in seen:
            k += 1
            while text[start : start + k] in seen and start + k <= limit:
                k += 1
        else:
            while k > 1 and text[start : start + k - 1] not in seen:
                k -= 1
        end = start + k
        if end > limit:
            if limit < len(text):
                break
            end = limit
        seen.add(text[start:end])
        cuts.append(end)
        start = end
    return start


def hashes(text: str, start: int, cuts: list) -> np.ndarray:
    """Hashes of the phrases of text[start:] that end at ``cuts``."""
    if not cuts:
        return np.zeros(0, U)
    codes = np.frombuffer(text[start : cuts[-1]].encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.array(cuts, np.int64) - start
    return span_hash(prefix_sums(mix(codes.astype(U) + BYTES_1[0])), np.append(0, ends[:-1]), ends)


def signature(h: np.ndarray) -> np.ndarray:
    """The least permuted hash of each slot, its top 32 bits."""
    out = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(h), 1024):
        part = (_FACTORS[:, None] * h[None, lo : lo + 1024] + _SHIFTS[:, None]).min(axis=1) >> U(32)
        np.minimum(out, part.astype(np.uint32), out=out)
    return out


def fingerprint(text: str) -> np.ndarray:
    cuts: list = []
    parse(text, 0, len(text), set(), cuts)
    return signature(hashes(text, 0, cuts))


def fingerprint_both(text: str, head: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text, and the fingerprints of the text and of the edited text; the parse of their common part is shared."""
    keep = len(text) - len(text) // 3
    edited = text[:keep] + head
    if edited == text:
        own = fingerprint(text)
        return edited, own, own
    seen: set = set()
    cuts: list = []
    at = parse(text, 0, keep, seen, cuts)
    common = signature(hashes(text, 0, cuts))
    tails = []
    for whole, phrases in ((text, set(seen)), (edited, seen)):
        cuts = []
        parse(whole, at, len(whole), phrases, cuts)
        tails.append(np.minimum(common, signature(hashes(whole, at, cuts))))
    return edited, tails[0], tails[1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SLOTS


DEALT = "bucket int, last int, did long, tie long, doc_id long, body binary"
DEALT_ARROW = pa.schema([("bucket", pa.int32()), ("last", pa.int32()), ("did", pa.int64()), ("tie", pa.int64()), ("doc_id", pa.int64()), ("body", pa.binary())])
LOWEST = -(2**63)


def bucket_of(did: np.ndarray, tie: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bucket 0 has the greatest ids. An id that stands several times among the sorted edges has that many buckets, by ranges of its rows' ties."""
    low, high = (np.searchsorted(edges, did, side) for side in ("left", "right"))
    part = ((tie.astype(np.float64) + 2.0**63) / 2.0**64 * np.maximum(high - low, 1)).astype(np.int64)
    return (len(edges) - low - np.clip(part, 0, np.maximum(high - low - 1, 0))).astype(np.int32)


def deal(edges: list, firsts: dict):
    """Rows to their buckets, compressed; the first row of a bucket goes to the bucket before as well."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        cut = np.array(edges, np.int64)
        for batch in batches:
            did, tie = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "tie"))
            bucket = bucket_of(did, tie, cut)
            body = [pack((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            extra = [i for i, at in enumerate(zip(did.tolist(), tie.tolist())) if at in firsts]
            rows = np.append(np.arange(len(did)), np.array(extra, np.int64))
            to = np.append(bucket, np.array([firsts[int(did[i]), int(tie[i])] for i in extra], np.int32))
            last = np.append(np.zeros(len(did), np.int32), np.ones(len(extra), np.int32))
            ids = batch.column("doc_id").take(pa.array(rows))
            yield pa.record_batch([pa.array(to, pa.int32()), pa.array(last), pa.array(did[rows]), pa.array(tie[rows]), ids, pa.array([body[i] for i in rows.tolist()], pa.binary())], schema=DEALT_ARROW)

    return run


def stream(batches):
    """Sorted rows of whole buckets to report rows: each row with the one after it."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    columns = [f.strip().split(" ") for f in DDL.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[t]) for n, t in columns])
    out: list[list] = []
    held = None  # bucket, doc_id, text of the row that waits for its successor
    waiting = None  # its row, but for near_next, and its fingerprint

    def close(after: np.ndarray) -> None:
        nonlocal waiting
        if waiting:
            out.append([*waiting[0], likeness(waiting[1], after)])
            waiting = None

    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5)))
        for bucket, last, doc_id, body in rows:
            if held is None or held[0] != bucket:
                held = waiting = None
                if last:
                    continue
            elif held[1] is None:
                continue  # this bucket's last row has met its successor
            text = unpack(body).decode("utf-8", "surrogatepass")
            if held is not None:
                _, _, own_id, own = held
                edited, a, b = fingerprint_both(own, text[: len(own) // 3])
                close(a)
                waiting = ([own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), likeness(a, b)], a)
            if last:
                close(fingerprint(text))
                held = (bucket, None, None, None)
            else:
                held = (bucket, True, doc_id, text)
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: fingerprints of its text and of its edited text, and their likeness (see the module)."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    text = F.col("text").cast("string")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("did"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    steps = 4 * width
    edges = base.agg(F.percentile_approx("did", [i / steps for i in range(1, steps)], 100 * steps).alias("e")).first()["e"]
    edges = sorted(edges or [])
    cut = np.array(edges, np.int64)

    def tops(batches):
        best: dict = {}
        for batch in batches:
            did, tie = (batch.column(c).to_numpy() for c in ("did", "tie"))
            bucket = bucket_of(did, tie, cut)
            order = np.lexsort((tie, did, bucket))
            ends = order[np.append(np.flatnonzero(np.diff(bucket[order])), len(order) - 1)] if len(order) else order
            for b, d, t in zip(bucket[ends].tolist(), did[ends].tolist(), tie[ends].tolist()):
                best[b] = max(best.get(b, (LOWEST, LOWEST)), (d, t))
        if best:
            yield pa.record_batch([pa.array(list(best), pa.int32()), *(pa.array([x[k] for x in best.values()], pa.int64()) for k in (0, 1))], names=["bucket", "did", "tie"])

    # a row per range: bounded by the number of ranges
    ranges = base.select("did", "tie").mapInArrow(lean(tops), "bucket int, did long, tie long").groupBy("bucket").agg(F.max(F.struct("did", "tie")).alias("top")).orderBy("bucket").collect()
    firsts = {(r["top"]["did"], r["top"]["tie"]): ranges[i - 1]["bucket"] for i, r in enumerate(ranges)}
    dealt = base.mapInArrow(lean(deal(edges, firsts)), DEALT).repartition(width, "bucket").sortWithinPartitions("bucket", "last", F.col("did").desc(), F.col("tie").desc(), "body")
    return dealt.mapInArrow(lean(stream), DDL)
