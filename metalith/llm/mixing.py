"""Mixing sources to target weights.

Token shares of the sources, raised to an exponent t in [0, 1] and normalised, are the
weights: t = 1 keeps the natural mix, t = 0 makes all sources equal. Lowering t raises
both the mix's entropy and the repetition of the smallest source, so either target is met by
sectioning the interval (``SECTIONS`` parts a pass, each pass one aggregate over the
sources) down to steps of SECTIONS ** -PASSES. With both targets the repetition limit prevails.

The weights are realised against a token budget: a source gets whole copies of all its
documents and, for the rest of its budget, the head of a permutation of its blocks.
Blocks are hash groups of documents, permuted by a seeded hash; the block that crosses
the budget is resolved by the documents' own hashes. What is left is one row per source
(copies, cut block, cut hash), so a document's fate is decided where it stands and no text is
shuffled; that plan is broadcast if it has at most ``BROADCAST_SOURCES`` rows, else joined under a salt.

Scale: no window spans a source: running sums go over blocks (at most ``MAX_BLOCKS`` a
source), then over the documents of the one cut block of each source.

Defined cases: tokens are words; a null or empty text has none; a source
without tokens keeps one copy of its documents; a null source counts as the empty
name; rows that share a doc_id and a number of tokens are taken or left together, each as its own row; an
empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metalith.llm.shared import SPACE_CLASS, free_name, settle

SECTIONS = 32
PASSES = 6
MAX_BLOCKS = 4096
BLOCK_TOKENS = 100_000
BROADCAST_SOURCES = 20_000
SALTS = 32
#: Production targets: a repetition limit of four copies, and 97 % of the greatest entropy.
MAX_REPEATS = 4.0
ENTROPY_SHARE = 0.97
SEED = 17


def n_tokens(text: Column) -> Column:
    trimmed = F.regexp_replace(text, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")
    return F.when(text.isNull() | (trimmed == ""), 0).otherwise(F.size(F.split(trimmed, f"{SPACE_CLASS}+"))).cast("bigint")


def exponent(sources: DataFrame, entropy_share: float | None = ENTROPY_SHARE, max_repeats: float | None = MAX_REPEATS, budget_share: float = 1.0) -> float:
    """The t that meets the wanted share of the greatest entropy, the least t that repeats no source too often, or the greater of both; 1 without a target.

    ``sources`` has a row (source, tokens) each with tokens > 0."""
    total = sources.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    tokens, n = float(total[0] or 0), total[1]
    if n < 2:
        return 1.0
    share = F.col("tokens") / F.lit(tokens)

    def measured(ts: list[float]) -> list[tuple[float, float]]:
        """(entropy, most repeats) of each exponent, in one aggregate."""
        row = sources.agg(*[x for t in ts for x in (F.sum(F.pow(share, F.lit(t))), F.sum(F.pow(share, F.lit(t)) * F.log(share)), F.max(F.pow(share, F.lit(t - 1.0))))]).first()
        out = []
        for i, t in enumerate(ts):
            z, s, most = row[3 * i : 3 * i + 3]
            out.append((math.log(z) - t * s / z, budget_share * most / z))
        return out

    def section(fits) -> float:
        """Least t in [0, 1] that ``fits``, which holds from some t on; 1 if none does."""
        lo, hi = 0.0, 1.0
        for _ in range(PASSES):
            ts = [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)]
            ok = [fits(*m) for m in measured(ts)]
            if ok[0]:
                return lo
            first = next((i for i, x in enumerate(ok) if x), None)
            if first is None:
                return hi
            lo, hi = ts[first - 1], ts[first]
        return hi

    bounds = []
    if entropy_share is not None:
        wanted = entropy_share * math.log(n)
        bounds.append(section(lambda entropy, _: entropy < wanted))
    if max_repeats is not None:
        bounds.append(section(lambda _, most: most <= max_repeats))
    return max(bounds, default=1.0)


def plan(docs: DataFrame, budget: float | None = None, entropy_share: float | None = ENTROPY_SHARE, max_repeats: float | None = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """Per source: tokens, weight, blocks, copies, cut_block, cut_hash. ``docs`` has (source, tokens, mark), mark being ``mark_of``."""
    sources = settle(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    full = sources.where("tokens > 0")
    total = full.agg(F.sum("tokens")).first()[0] or 0
    budget = float(total if budget is None else budget)
    t = exponent(full, entropy_share, max_repeats, budget / total if total else 1.0)
    z = full.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(t)))).first()[0] or 1.0
    weighted = full.select(
        "source",
        "tokens",
        (F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(t)) / F.lit(z)).alias("weight"),
        F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS))).cast("int").alias("blocks"),
    )
    share = weighted.withColumn("copies", F.floor(F.col("weight") * F.lit(budget) / F.col("tokens"))).withColumn(
        "rest", F.floor(F.col("weight") * F.lit(budget) - F.col("copies") * F.col("tokens"))
    )
    shared = with_plan(docs, share.select("source", "blocks", "rest"))
    blocked = settle(shared.groupBy("source", block_of(seed).alias("block"), "rest").agg(F.sum("tokens").alias("tokens")))
    along = Window.partitionBy("source").orderBy("block")
    cut = (
        blocked.withColumn("upto", F.sum("tokens").over(along))
        .where(F.col("upto") > F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.struct("block", (F.col("rest") - (F.col("upto") - F.col("tokens"))).alias("left"))).alias("c"))
        .select("source", F.col("c.block").alias("cut_block"), F.col("c.left").alias("left"))
    )
    cut = settle(cut)
    inside = with_plan(docs, share.select("source", "blocks").join(cut, "source")).where(block_of(seed) == F.col("cut_block"))
    by_hash = inside.groupBy("source", "left", "mark").agg(F.sum("tokens").alias("tokens"))
    ends = (
        by_hash.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("mark")))
        .where(F.col("upto") <= F.col("left"))
        .groupBy("source")
        .agg(F.max("mark").alias("cut_hash"))
    )
    planned = share.select("source", "tokens", "weight", "blocks", "copies").join(cut.select("source", "cut_block"), "source", "left").join(ends, "source", "left")
    return settle(planned)


def mark_of(doc_id: Column, tokens: Column, seed: int = SEED) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, tokens)


def block_of(seed: int) -> Column:
    """A document's block as its place in the source's permutation: a seeded hash of its block number."""
    return F.xxhash64(F.lit(seed), F.col("source"), F.pmod(F.xxhash64(F.col("mark")), F.col("blocks")))


def with_plan(docs: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Documents with the row of their source."""
    if rows.count() <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(rows), "source", how)
    salted = rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("_salt", F.pmod(F.col("mark"), F.lit(SALTS)).cast("int")).join(salted, ["source", "_salt"], how).drop("_salt")


def copies(docs: DataFrame, budget: float | None = None, entropy_share: float | None = ENTROPY_SHARE, max_repeats: float | None = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, copies, row) per row of ``docs``; row holds the input's columns."""
    name = free_name(docs)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))
    base = held.select(name, F.coalesce(F.col(f"{name}.source").cast("string"), F.lit("")).alias("source"), n_tokens(F.col(f"{name}.text")).alias("tokens"))
    base = base.withColumn("mark", mark_of(F.col(f"{name}.doc_id"), F.col("tokens"), seed))
    planned = plan(settle(base.select("source", "tokens", "mark")), budget, entropy_share, max_repeats, seed)
    joined = with_plan(base, planned.drop("tokens"), "left")
    block = block_of(seed)
    head = (block < F.col("cut_block")) | ((block == F.col("cut_block")) & (F.col("mark") <= F.col("cut_hash")))
    n = F.when(F.col("copies").isNull(), 1).otherwise(F.col("copies") + F.when(F.coalesce(head, F.lit(False)), 1).otherwise(0)).cast("bigint")
    return joined.select(F.col(f"{name}.doc_id").alias("doc_id"), F.col(f"{name}.source").alias("source"), F.col("tokens").alias("n_tokens"), n.alias("copies"), F.col(name).alias("row"))


def mix(docs: DataFrame, **targets) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as its source's weight asks."""
    chosen = copies(docs, **targets).where("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")).select("row.*")
