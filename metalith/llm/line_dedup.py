"""Cross-site boilerplate lines.

A line that stands on ``SITES`` or more distinct sites is boilerplate and is removed from
every document. Per line (128-bit key of the trimmed line) the sites are merged into a
HyperLogLog sketch, by partial and final aggregation. Lines clearly above the threshold
are taken by the sketch; those within four standard errors of it get an exact distinct
count; the rest is left alone.

Scale: a line on a third of all documents is one sketch per map task. The found lines are
broadcast only if their number is at most ``BROADCAST_LINES``; beyond that they are
joined with the documents' lines under a salt, so that a frequent line is
split over tasks. The text is shuffled once, to meet its document's list of lines.

A whole document copied to many sites isn't boilerplate. With ``once``, as the pipeline asks, texts that differ
in white space only count as one occurrence, that of the least doc_id, before sites are counted; so a
line's spread is that of different texts. The lines found are removed from every document, as without it.
Copies are found by a 128-bit digest of the text, aggregated partially; only the digests that have
several occurrences meet the documents. The query op7 counts every row, as its SQL does.

Defined cases: a null text stays null and has no lines; lines without a word are neither
counted nor removed; white space around a line is ignored when lines are compared; a null
site counts as one site of its own; repeated rows are treated alike; a document that
loses all its lines keeps its row with an empty text (only blank lines may remain);
texts are read whole; extra columns pass through, but for those named as the counts where these are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metalith.llm.shared import free_name, settle

SITES = 10
SKETCH_LG = 10
BROADCAST_LINES = 200_000
SALTS = 32


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, sites: int = SITES, text: str = "text", site: str = "source") -> DataFrame:
    """(key) of the lines on at least ``sites`` sites."""
    lines = (
        docs.select(F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("")).alias("site"), F.explode(lines_of(F.col(text))).alias("line"))
        .where(has_word(F.col("line")))
        .select(line_key(F.col("line")).alias("key"), "site")
    )
    error = 4 * 1.04 / 2 ** (SKETCH_LG / 2)
    sketched = settle(lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_LG)).alias("n")).where(F.col("n") >= sites * (1 - error)))
    near = sketched.where(F.col("n") <= sites * (1 + error)).select("key")
    exact = narrowed(lines, near).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites)
    return settle(sketched.where(F.col("n") > sites * (1 + error)).select("key").unionByName(exact.select("key")))


def once_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """(text, site) of one occurrence of each text: that of its least doc_id, a null one counting as the greatest, and of its least site."""
    whole = F.unhex(F.md5(F.translate(F.col(text), " \t\n\x0b\x0c\r", "")))
    marked = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(site).alias("site"), whole.alias("whole"), F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col(site)).alias("at"))
    copied = settle(marked.groupBy("whole").agg(F.min("at").alias("first"), F.max("at").alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("whole", "first"))
    if copied.count() <= BROADCAST_LINES:
        joined = marked.join(F.broadcast(copied), "whole", "left")
    else:
        salted = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = marked.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int")).join(salted, ["whole", "salt"], "left")
    return joined.where(F.col("first").isNull() | F.col("at").eqNullSafe(F.col("first"))).select("text", "site")


def narrowed(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose key is among ``keys``."""
    if keys.count() <= BROADCAST_LINES:
        return lines.join(F.broadcast(keys), "key", "left_semi")
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64(*lines.columns), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left_semi").drop("salt")


def remove_boilerplate(docs: DataFrame, sites: int = SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source", counts: bool = False, once: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text; with ``counts`` also n_lines and n_removed; with ``once`` copies of a text count as one."""
    bad = boilerplate(once_each(docs, doc_id, text, site), sites, "text", "site") if once else boilerplate(docs, sites, text, site)
    names: list[str] = []
    for _ in range(4):
        names.append(free_name(docs, *names))
    row, whole, did, gone = names
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(text).alias(whole), F.xxhash64(F.col(doc_id), F.col(text)).alias(did))
    lines = held.select(F.col(did).alias("did"), F.explode(lines_of(F.col(whole))).alias("line")).where(has_word(F.col("line"))).select("did", line_key(F.col("line")).alias("key"))
    found = narrowed(lines, bad).groupBy("did").agg(F.collect_set("key").alias(gone)).withColumnRenamed("did", did)
    body = lines_of(F.col(whole))
    kept = F.filter(body, lambda x: ~(has_word(x) & F.array_contains(F.col(gone), line_key(x))))
    cleaned = F.when(F.col(gone).isNull(), F.col(whole)).otherwise(F.array_join(kept, "\n"))
    out = [cleaned.alias(c) if c == text else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns if not (counts and c.lower() in ("n_lines", "n_removed"))]
    if counts:
        n = F.coalesce(F.size(F.filter(body, has_word)), F.lit(0))
        left = F.coalesce(F.size(F.filter(kept, has_word)), F.lit(0))
        out += [F.when(F.col(whole).isNull(), 0).otherwise(n).cast("bigint").alias("n_lines"), F.when(F.col(gone).isNull(), 0).otherwise(n - left).cast("bigint").alias("n_removed")]
    return held.join(found.hint("shuffle_hash"), did, "left").select(*out)
