"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document. The ledger keeps the measurements and one
long ``failed_bits`` with a bit per failed rule; a policy is a named, versioned mask
of the rules that reject. Applying another policy, or asking what a policy would keep
without one of its rules, needs only bitwise arithmetic on the ledger, never the text.

Everything is a DataFrame expression: there is no shuffle up to the ledger, and
``ablation`` is one partial aggregate over longs.

Defined cases: a null text has no words and fails ``few_words``; an empty text
likewise; very long texts are measured whole (3-word windows are sorted within
their row, by 64-bit hashes: two different windows of one row that share a hash would count as one); repeated rows each get their own ledger row; extra columns pass through,
and when an input column has a ledger column's name the ledger's value wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metalith.llm.shared import free_name

SYMBOLS = "#*$%&|<>"
#: Hashes that are looked up in a list, one by one.
LISTED = 32
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL condition on the measurements is true."""

    bit: int
    name: str
    fails: str


#: Bits are permanent: a rule keeps its bit in every version of every policy.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "too_many_words", "n_words > 1000000"),
    Rule(3, "short_mean_word", "word_chars < 2 * n_words"),
    Rule(4, "long_mean_word", "word_chars > 15 * n_words"),
    Rule(5, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(6, "duplicate_lines", "n_lines > 1 AND 10 * n_dup_lines > 7 * n_lines"),
)
BIT = {r.name: r.bit for r in RULES}
#: Name and version to the rules that reject.
POLICIES = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("web", 1): ("few_words", "repeated_windows", "too_many_words", "short_mean_word", "long_mean_word", "symbols", "duplicate_lines"),
    #: Length alone rejects nothing; too_many_words stays in the ledger. op9 reports version 1, as its SQL does.
    ("web", 2): ("few_words", "repeated_windows", "short_mean_word", "long_mean_word", "symbols", "duplicate_lines"),
}
DEFAULT_POLICY = ("web", 1)


def policy_mask(policy: tuple[str, int]) -> int:
    return sum(1 << BIT[name] for name in POLICIES[policy])


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more in the row; windows are compared by a 64-bit hash.

    The bare hashes are sorted. Where some stand twice, the windows that have one of them are looked up, in a list while
    it is short and else by sorting (hash, position), and the union of what they cover is measured; both ways find the same."""

    def measured(w: Column) -> Column:
        last = F.size(w) - 2
        hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
        return F.when(last >= 2, _bind(hashes, counted)).otherwise(F.lit(0).cast("bigint"))

    def counted(h: Column) -> Column:
        return _bind(_bind(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1) == x, F.lit(False))))), lambda twice: covered(h, twice))

    def covered(h: Column, twice: Column) -> Column:
        looked_up = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: F.array_contains(twice, F.get(h, i - 1)))
        return F.when(F.size(twice) == 0, F.lit(0).cast("bigint")).when(F.size(twice) <= LISTED, _bind(looked_up, union)).otherwise(_bind(by_sorting(h), union))

    def by_sorting(h: Column) -> Column:
        def twins(s: Column) -> Column:
            def same(x: Column, k: Column) -> Column:
                return F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        return _bind(F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), (k + 1).alias("i")))), twins)

    def union(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)

    return _bind(words, measured)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASURES``."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.regexp_extract_all(body, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def long(c: Column) -> Column:
        return c.cast("bigint")

    counts = _bind(words, lambda w: F.struct(long(F.size(w)).alias("n"), _repeat_words(w).alias("repeat")))
    counted = F.struct(
        counts.alias("words"),
        long(F.length(F.translate(body, " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        long(F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).alias("n_symbols"),
        _bind(lines, lambda x: F.struct(long(F.size(x)).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
    )
    kept = [c for c in docs.columns if c.lower() not in {m.lower() for m in MEASURES}]
    name = free_name(docs)
    held = docs.select(*[F.col(f"`{c}`") for c in kept], counted.alias(name))
    fields = {"n_words": "words.n", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "lines.dup", "n_repeat_words": "words.repeat", "n_lines": "lines.n"}
    return held.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{name}.{fields[m]}").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed_bits``; each rule is evaluated once."""
    bits = F.lit(0).cast("bigint")
    for rule in RULES:
        bits = bits + F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint")
    out = measure(docs, text)
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c.lower() != "failed_bits"], bits.alias("failed_bits"))


def verdict(policy: tuple[str, int] = DEFAULT_POLICY) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed_bits").bitwiseAND(F.lit(policy_mask(policy))) == 0


def ablation(led: DataFrame, policy: tuple[str, int] = DEFAULT_POLICY) -> DataFrame:
    """One row per rule of the policy: documents it fails, those only it rejects, and those the policy would keep without it."""
    mask = policy_mask(policy)
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask))
    counts = []
    for name in POLICIES[policy]:
        bit = 1 << BIT[name]
        counts.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.sum(F.when(failed.bitwiseAND(F.lit(bit)) != 0, 1).otherwise(0)).cast("bigint").alias("n_failed"),
                F.sum(F.when(failed == bit, 1).otherwise(0)).cast("bigint").alias("n_failed_alone"),
                F.sum(F.when(failed.bitwiseAND(F.lit(mask & ~bit)) == 0, 1).otherwise(0)).cast("bigint").alias("n_kept_without"),
            )
        )
    return led.agg(F.array(*counts).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def quality_report(docs: DataFrame, policy: tuple[str, int] = DEFAULT_POLICY) -> DataFrame:
    """The contract's row per document."""
    led = ledger(docs)
    return led.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(F.lit(policy_mask(("base", 1)))) != 0).alias("base_failed"),
        verdict(policy).alias("kept"),
        "failed_bits",
    )


def keep_good(docs: DataFrame, policy: tuple[str, int] = DEFAULT_POLICY) -> DataFrame:
    """The documents the policy keeps, with their own columns only."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    return ledger(packed).where(verdict(policy)).select("_row.*")
