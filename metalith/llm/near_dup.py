"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct 5-word shingles. Its sketch has ``REGISTERS`` registers:
register i is floor(1 - log_b m_i), where m_i is the least of the set's exponential
variables of rate ``RATE``, truncated to 16 bits. Registers of a union are the maxima of
registers, so sketches merge; with b near 1 the chance that two registers agree is
close to the similarity of the sets, so bands of register values find similar sets.

1. Sketch every whole text once (Arrow batches); rows with equal sets, by a 128-bit
   digest of the set, form a class. A group of copies, however
   large, is one class from here on: the class is a partial aggregate. What follows links classes,
   never ids, so rows that share an id, or have none, keep the links of each text.
2. Deal each class by bands of ``BAND`` registers. Per band value the least class is the centre and
   all others form one candidate pair with it (a star, never all pairs); each class keeps the centre it
   shares most values with.
3. In this and every later round, the similarity of each candidate pair is estimated from the two sketches by likelihood;
   what can be near is verified on full sets, exactly, and what is linked is joined into components.
4. Band values that still hold several components are torn. A shingle that no other class
   of a torn value has can be in no common part, so with c shingles that some other has, n in all
   and m in the other set, the similarity is at most min(c, c') / (n + m - min(c, c')). This exact bound
   clears most torn values. In the rest the class with the least share of own
   shingles is the next centre, and after two such rounds the pairs across components are found by
   their rarest shingles (an exact prefix filter). Classes inside one component need no comparison: a link
   between them changes nothing.

A pair at the threshold is missed by all bands with a chance below 1e-7.

Defined cases: a null text, or one without words, is empty and linked with nothing; a
text of fewer than five words is one shingle; repeated rows each get a row; rows that share a doc_id but not a text
are linked each by its own text, and each gets the least id that its text reaches; a null doc_id counts as the
greatest id, and where a component has no other, its component_id is null and its rows are kept; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metalith.llm.kernels import BYTES_1, U, mix, prefix_sums, slices, span_hash, split_words
from metalith.llm.shared import free_name, lean, settle

SHINGLE_WORDS = 5
PERCENT = 75
REGISTERS = 96
BAND = 3
BASE = 1.001
RATE = 20.0
TOP = 2**16 - 2
#: A pair whose estimate is below this isn't confirmed: over five standard errors under the threshold.
ESTIMATE_FLOOR = 0.5
STAR_ROUNDS = 2
_FACTORS = mix(np.arange(1, REGISTERS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_SHIFTS = mix(np.arange(1, REGISTERS + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(buf: np.ndarray, offsets: np.ndarray):
    """Row and hash of each distinct shingle, sorted by both."""
    buf = LOWER[buf]
    starts, ends, bounds = split_words(buf, offsets)
    words = span_hash(prefix_sums(BYTES_1[buf]), starts, ends)
    sums = prefix_sums(words)
    count = np.diff(bounds)
    size = np.minimum(count, SHINGLE_WORDS)
    n = np.where(count > 0, count - size + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1], n)
    h = span_hash(sums, at, at + size[row])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def registers(h: np.ndarray) -> np.ndarray:
    """SetSketch of a set of hashes: the least uniform of each register, as an exponential, on a logarithmic scale."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, U)
    for lo in range(0, len(h), 1024):
        np.minimum(least, (_FACTORS[:, None] * h[None, lo : lo + 1024] + _SHIFTS[:, None]).min(axis=1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


_GRID = np.linspace(0.0, 1.0, 101)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of pairs of sketches (rows), given the sets' sizes.

    Registers of two sets are a > b, a < b or equal with the probabilities of the joint model; the
    similarity that makes the three counts likeliest is searched on a grid."""
    up = (a > b).sum(axis=1)
    down = (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u = (na / (na + nb))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = _GRID[None, :] * most

    def p(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    p_up, p_down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
    ll = up[:, None] * np.log(np.maximum(p_up, 1e-9)) + down[:, None] * np.log(np.maximum(p_down, 1e-9)) + same[:, None] * np.log(np.maximum(1 - p_up - p_down, 1e-9))
    return j[np.arange(len(a)), ll.argmax(axis=1)]


SKETCH = "rid long, did long, doc_id long, n_shingles long, d1 long, d2 long, sketch binary"
SKETCH_ARROW = pa.schema([("rid", pa.int64()), ("did", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.binary())])
MEMBERS = "n_shingles long, d1 long, d2 long, members binary"


def digests(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set, whatever the order of its members."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        sums = np.append(U(0), np.cumsum(mix(h ^ U(salt))))
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U)).view(np.int64))
    return out


def sketch(batches):
    for batch in batches:
        n, d1, d2, sketches = [], [], [], []
        for _, buf, offsets in slices(batch.column("text")):
            row, h = shingle_sets(buf, offsets)
            bounds = np.searchsorted(row, np.arange(len(offsets)))
            n.append(np.diff(bounds))
            for out, d in zip((d1, d2), digests(h, bounds)):
                out.append(d)
            sketches += [registers(h[lo:hi]).tobytes() if hi > lo else b"" for lo, hi in zip(bounds[:-1], bounds[1:])]
        if n:
            columns = [batch.column(c) for c in ("rid", "did", "doc_id")] + [pa.array(np.concatenate(x), pa.int64()) for x in (n, d1, d2)]
            yield pa.record_batch([*columns, pa.array(sketches, pa.binary())], schema=SKETCH_ARROW)


def bands(batches):
    """Classes to (band value, class)."""
    for batch in batches:
        did = batch.column("did").to_numpy()
        regs = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(len(did), REGISTERS // BAND, BAND).astype(U)
        value = mix(regs[:, :, 0] | (regs[:, :, 1] << U(16)) | (regs[:, :, 2] << U(32)) | (np.arange(REGISTERS // BAND, dtype=U)[None, :] << U(48)))
        yield pa.record_batch([pa.array(value.ravel().view(np.int64)), pa.array(np.repeat(did, REGISTERS // BAND))], names=["band", "did"])


def sets(batches):
    """Whole texts to the digests of their sets and the sorted shingle hashes, as 8-byte numbers."""
    for batch in batches:
        for _, buf, offsets in slices(batch.column("text")):
            row, h = shingle_sets(buf, offsets)
            bounds = np.searchsorted(row, np.arange(len(offsets)))
            members = [h[lo:hi].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:])]
            yield pa.record_batch([pa.array(np.diff(bounds), pa.int64()), *map(pa.array, digests(h, bounds)), pa.array(members, pa.binary())], names=["n_shingles", "d1", "d2", "members"])


def near_pairs(batches):
    """Pairs with both sketches and full sets to the links among them: the similarity of each is estimated from the sketches, and where it can reach the threshold the sets decide."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, REGISTERS) for c in ("sketch_a", "sketch_b"))
        x, y = batch.column("members_a"), batch.column("members_b")
        na, nb = (pa.compute.binary_length(c).to_numpy(zero_copy_only=False) // 8 for c in (x, y))
        keep = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
        for lo in range(0, len(a), 4096):
            some = lo + np.flatnonzero(keep[lo : lo + 4096])
            keep[some] = estimate(a[some], b[some], na[some].astype(float), nb[some].astype(float)) >= ESTIMATE_FLOOR
        for i in np.flatnonzero(keep):
            p, q = (np.frombuffer(c[i].as_buffer(), U) for c in (x, y))
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep[i] = 100 * both >= PERCENT * (len(p) + len(q) - both)
        yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def confirmed(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near: estimated from the sketches, then verified on full sets, where both meet."""
    left, right = members.toDF("a", "sketch_a", "members_a"), members.toDF("b", "sketch_b", "members_b")
    return settle(pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(lean(near_pairs), "a long, b long"))


def own_shingles(batches):
    """Documents to (shingle, document)."""
    for batch in batches:
        did = batch.column("did").to_numpy()
        parts = [np.frombuffer(x, np.int64) for x in batch.column("members").to_pylist()]
        sizes = [len(x) for x in parts]
        for lo in range(0, len(parts), 256):
            yield pa.record_batch([pa.array(np.concatenate(parts[lo : lo + 256])), pa.array(np.repeat(did[lo : lo + 256], sizes[lo : lo + 256]))], names=["shingle", "did"])


def possible(n_a, c_a, n_b, c_b):
    """Whether two sets of these sizes, with so many shingles that others have, can be similar enough."""
    common = F.least(c_a, c_b)
    return 100 * common >= PERCENT * (n_a + n_b - common)


def torn(shared: DataFrame, found: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(band, did, component[, n, c]) of the band values with several components; with sizes, of the documents that can have a partner there."""
    labelled = shared.join(found, "did", "left").select("band", "did", F.coalesce("component", "did").alias("component"))

    def several(df: DataFrame) -> DataFrame:
        bands_ = df.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), *([F.min("n").alias("least_n")] if sizes is not None else []))
        return df.join(bands_.where("low <> high").drop("low", "high"), "band")

    if sizes is None:
        return several(labelled)
    sized = several(labelled.join(sizes, "did"))
    least = F.greatest("least_n", "c")
    return several(sized.where(100 * F.col("c") >= PERCENT * (F.col("n") + least - F.col("c"))).drop("least_n")).drop("least_n")


def components(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(did, component) for every class in a link: the least number reachable.

    Alternates large-star and small-star steps, each an aggregate over neighbours, until
    every class points at one that points nowhere; every step is written to the shared folder."""
    edges = links if before is None else links.unionByName(before.where("did <> component").select(F.col("did").alias("a"), F.col("component").alias("b")))
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        # large star: greater neighbours move to the least of a node's neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # small star: lesser neighbours and the node itself move to the least
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = settle(small)
        ends = edges.select("a", "b", F.lit(False).alias("root")).unionByName(edges.select(F.col("b").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(True).alias("root")))
        open_ = ends.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max("root").alias("root")).where("low <> high OR root AND low IS NOT NULL")
        if open_.isEmpty():
            return edges.select(F.col("a").alias("did"), F.col("b").alias("component"))


def sharing_rare(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) across components that can be similar enough; ``docs`` has (did, component, n).

    Each document's shingles are put in one order for all, the rarest first. The first
    common shingle of a pair, at places i and j, leaves a common part of at most min(n - i, m - j);
    so a pair is met at a shingle only where that bound allows it, and none is lost. Per shingle
    the commonest component isn't paired with itself: the rows of the others meet all rows,
    after those were left out that no row of the shingle, however small its set, can match."""
    each = members.select("did", "members").join(docs, "did", "left_semi").mapInArrow(lean(own_shingles), "shingle long, did long")
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    placed = each.join(often, "shingle").withColumn("place", F.row_number().over(Window.partitionBy("did").orderBy("df", "shingle")) - 1)
    left = F.col("n") - F.col("place")
    rows = settle(placed.where("df > 1").join(docs, "did").where(100 * left >= PERCENT * F.col("n")).select("shingle", "did", "component", "n", left.alias("room")))
    counted = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"))
    common = counted.groupBy("shingle").agg(F.max_by("component", F.struct("k", "component")).alias("common"), F.min("n").alias("least_n"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    most = F.col("room")
    open_ = rows.join(common, "shingle").where(100 * most >= PERCENT * (F.col("n") + F.greatest("least_n", most) - most))
    one = open_.where(F.col("component") != F.col("common")).select("shingle", F.col("did").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("room").alias("rx"))
    all_ = open_.select("shingle", F.col("did").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("room").alias("ry"))
    met = one.join(all_, (one["shingle"] == all_["shingle"]) & (F.col("cx") != F.col("cy")) & possible(F.col("nx"), F.col("rx"), F.col("ny"), F.col("ry")))
    return met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def with_sizes(dids: DataFrame, members: DataFrame) -> DataFrame:
    """(did, n, c): shingles of each of these documents, and how many of them another one has too. Shingles are counted by partial aggregation."""
    some = members.select("did", "members").join(dids, "did", "left_semi")
    lone = some.mapInArrow(lean(own_shingles), "shingle long, did long").groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("did").alias("did")).where("k = 1").groupBy("did").agg(F.count(F.lit(1)).alias("own"))
    n = (F.length("members") / 8).cast("long")
    return settle(some.select("did", n.alias("n")).join(lone, "did", "left").select("did", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("c")))


NO_ID = 2**63 - 1


def labelled_rows(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """Per row of ``docs``: rid (null without a column of row numbers), did, doc_id, n_shingles, component (the least did that it reaches) and group (a number of the component; null without words)."""
    number = F.col(f"`{rid}`") if rid else F.lit(None)
    base = docs.select(number.cast("long").alias("rid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = settle(base.mapInArrow(lean(sketch), SKETCH))
    by_set = ["n_shingles", "d1", "d2"]
    grouped = sketched.where("n_shingles > 0").groupBy(*by_set).agg(F.min("did").alias("least"), F.any_value("sketch").alias("sketch"))
    # the numbers of the classes are written once, and so stay what they are
    classes = settle(grouped.withColumn("did", F.monotonically_increasing_id()))
    dealt = classes.mapInArrow(lean(bands), "band long, did long")
    centres = dealt.groupBy("band").agg(F.min("did").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settle(dealt.join(centres, "band").select("band", "did", "centre"))
    stars = shared.where("did <> centre").groupBy(F.col("did").alias("a"), F.col("centre").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    tried = settle(stars.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b")))
    near = settle(classes.join(shared.select("did").distinct(), "did", "left_semi").select(*by_set, "least", "did", "sketch"))
    texts = base.select("did", "text").join(near.select(F.col("least").alias("did")).distinct().hint("shuffle_hash"), "did", "left_semi")
    members = texts.mapInArrow(lean(sets), MEMBERS).dropDuplicates(by_set).join(near.hint("shuffle_hash"), by_set)
    members = settle(members.select("did", "sketch", "members"))
    shared = shared.select("band", "did")
    found = components(confirmed(tried, members))
    sizes = with_sizes(torn(shared, found).select("did").distinct(), members)
    for _ in range(STAR_ROUNDS):
        rest = settle(torn(shared, found, sizes))
        if rest.isEmpty():
            break
        centre = rest.groupBy("band").agg(F.max_by(F.struct("did", "component", "n", "c"), F.struct(F.col("c") / F.col("n"), -F.col("did"))).alias("o"))
        rays = rest.join(centre, "band").where((F.col("component") != F.col("o.component")) & possible(F.col("n"), F.col("c"), F.col("o.n"), F.col("o.c")))
        rays = rays.select(F.greatest("did", "o.did").alias("a"), F.least("did", "o.did").alias("b"), F.col("did").alias("x")).groupBy("x", "a", "b").agg(F.count(F.lit(1)).alias("n"))
        rays = rays.join(tried, ["a", "b"], "left_anti").groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("n", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        rays = settle(rays)
        tried = tried.unionByName(rays)
        found = components(confirmed(rays, members), found)
    rest = torn(shared, found, sizes).select("did", "component", "n").distinct()
    across = settle(sharing_rare(settle(rest), members).join(tried, ["a", "b"], "left_anti"))
    found = components(confirmed(across, members), found)
    numbered = classes.select(*by_set, "did", "least").join(found, "did", "left").select(*by_set, "least", F.coalesce("component", "did").alias("group"))
    least = numbered.groupBy("group").agg(F.min("least").alias("component"))
    named = numbered.drop("least").join(least, "group")
    return sketched.drop("sketch").join(named, by_set, "left").select("rid", "did", "doc_id", "n_shingles", F.coalesce("component", "did").alias("component"), "group")


def group_near(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    return labelled_rows(docs).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("component") != NO_ID, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        (F.col("did") == F.col("component")).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of its least doc_id, the first such row if there are several; rows without words stay.

    The rows are numbered in a written copy, so that rows are dropped and never ids: another text
    under the doc_id of a dropped one stays. The numbers to drop meet the documents in one shuffle join."""
    rid = free_name(docs)
    rows = settle(docs.withColumn(rid, F.monotonically_increasing_id()))
    marked = settle(labelled_rows(rows, rid).where(F.col("group").isNotNull()).select("rid", "did", "group"))
    first = marked.groupBy("group").agg(F.min(F.struct("did", "rid")).alias("m")).select("m.rid")
    gone = marked.select("rid").join(first, "rid", "left_anti").select(F.col("rid").alias(rid))
    return rows.join(gone.hint("shuffle_hash"), rid, "left_anti").select(*[f"`{c}`" for c in docs.columns])
