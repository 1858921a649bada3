"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes every result but the last to
the shared folder and reads it again as the next stage's documents, which also cuts the lineage.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metalith.llm import line_dedup, mixing, near_dup, quality
from metalith.llm.queries import tokenizer
from metalith.llm.shared import settle, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the production policy, however long they are."""
    return quality.keep_good(docs, ("web", 2))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that different texts have on many sites; whole copies are left to the next stage."""
    return with_length(line_dedup.remove_boilerplate(docs, once=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the weights of their sources ask."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens and ids of each document, and the text that the ids decode to."""
    return tokenizer(spark).encode(docs, decoded="text")


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.select(*[F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", encoding),
]
#: Near duplicates and the exponent's search are not said in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
