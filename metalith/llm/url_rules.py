"""URL rules by a sort-merge range join.

A rule is ``host/path`` with a verdict. Its canonical key is the host's labels
reversed, a space, then the path; every url on that host whose path starts with the
rule's lies in the key interval from that key up to its prefix successor. A url takes
part once for each suffix of its host, which is how a rule fits all subdomains.

Rules of one host nest like brackets, so a sweep over the sorted keys needs only a
stack: the opening event of a rule carries the stack after pushing, its closing event
the stack after popping (both folded from the rules alone). Urls and events are then
sorted together, and each url reads the last event before it; the top of that stack
is the longest fitting rule on that host.

Scale: the sweep runs per (host suffix, salt), with the events of a host repeated in
each salt and its urls dealt over them, so a host with a third of all pages is swept
by many tasks. Urls meet only suffixes that some rule names. No row is collected.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule and
the default verdict; repeated rows each keep their row; a rule given twice with
different verdicts blocks; an empty rule table leaves every url the default; null rules
are ignored; columns of the input other than the key and the url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metalith.llm.shared import lower_ascii, shuffle_width

DEFAULT_VERDICT = "allow"


def key_of(path: Column, end: bool = False) -> Column:
    """A path's sort key, its UTF-8 bytes; ``end``: the first key after all paths it is a prefix of (no UTF-8 text has the byte FF)."""
    body = F.encode(path, "UTF-8")
    return F.concat(body, F.unhex(F.lit("FF"))) if end else body


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def events(rules: DataFrame) -> DataFrame:
    """Rules (``rule``, ``verdict``) to sweep events: (``suffix``, ``key``, ``stack`` of rules that are open from the key on)."""
    ruled = (
        rules.where(F.col("rule").isNotNull() & F.col("verdict").isNotNull())
        .select(
            "rule",
            "verdict",
            reversed_host(lower_ascii(F.substring_index("rule", "/", 1))).alias("suffix"),
            F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"),
        )
        .groupBy("rule", "suffix", "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    item = F.struct("path", "rule", "verdict")
    per_host = ruled.groupBy("suffix").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = "array<struct<path:string,rule:string,verdict:string>>"

    def push(acc: Column, x: Column) -> Column:
        """acc.stack: open rules; acc.out: (key, stack) so far. Rules that x doesn't nest in are closed first, the innermost first."""
        is_open = lambda s: x["path"].startswith(s["path"])
        open_ = F.filter(acc["stack"], is_open)
        closed = F.reverse(F.filter(acc["stack"], lambda s: ~is_open(s)))
        closing = F.transform(closed, lambda s: F.struct(key_of(s["path"], end=True).alias("at"), F.filter(acc["stack"], lambda o: s["path"].startswith(o["path"]) & (o["path"] != s["path"])).alias("stack")))
        stack = F.concat(open_, F.array(x))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], closing, F.array(F.struct(key_of(x["path"]).alias("at"), stack.alias("stack")))).alias("out"))

    start = F.struct(F.array().cast(empty).alias("stack"), F.array().cast(f"array<struct<at:binary,stack:{empty}>>").alias("out"))
    swept = per_host.select("suffix", F.aggregate("items", start, push).alias("acc"))
    rest = F.transform(
        F.reverse(F.col("acc.stack")),
        lambda s: F.struct(key_of(s["path"], end=True).alias("at"), F.filter(F.col("acc.stack"), lambda o: s["path"].startswith(o["path"]) & (o["path"] != s["path"])).alias("stack")),
    )
    return swept.select("suffix", F.explode(F.concat(F.col("acc.out"), rest)).alias("e")).select("suffix", F.col("e.at").alias("at"), F.col("e.stack").alias("stack"))


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, key: str = "page_id", url: str = "url", salts: int | None = None) -> DataFrame:
    """Per row of ``pages``: key, url, host, path, the longest fitting rule (or null) and the verdict."""
    spark: SparkSession = pages.sparkSession
    salts = salts or 4 * shuffle_width(spark)
    marks = events(rules)
    named = marks.select("suffix").distinct()
    rows = (
        pages.select(F.col(key).alias("row_key"), F.col(url).cast("string").alias("row_url"))
        .groupBy("row_key", "row_url")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("row_key", "row_url", "n", host_of(F.col("row_url")).alias("host"), path_of(F.col("row_url")).alias("path"))
    )
    labels = F.reverse(F.split("host", r"\."))
    probes = rows.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, F.lit(1), i), "."))))
    probes = probes.join(named, "suffix", "left_semi").select(
        "suffix",
        F.pmod(F.xxhash64("row_key", "row_url"), F.lit(salts)).cast("int").alias("salt"),
        key_of(F.col("path")).alias("at"),
        F.lit(1).alias("kind"),
        F.lit(None).cast(marks.schema["stack"].dataType).alias("stack"),
        "row_key",
        "row_url",
    )
    marked = marks.select(
        "suffix",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        "at",
        F.lit(0).alias("kind"),
        "stack",
        F.lit(None).cast(probes.schema["row_key"].dataType).alias("row_key"),
        F.lit(None).cast("string").alias("row_url"),
    )
    sweep = Window.partitionBy("suffix", "salt").orderBy("at", "kind", F.size(F.col("stack")).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    won = (
        marked.unionByName(probes)
        .withColumn("active", F.last("stack", ignorenulls=True).over(sweep))
        .where((F.col("kind") == 1) & (F.size("active") > 0))
        .select("row_key", "row_url", F.element_at("active", -1).alias("top"))
        .select("row_key", "row_url", F.length("top.rule").alias("len"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))
    )
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct("len", "rule", "verdict")))
    bare = rows.select("row_key", "row_url", F.lit(None).cast("int").alias("len"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), "n")
    merged = bare.unionByName(won.withColumn("n", F.lit(0).cast("bigint"))).groupBy("row_key", "row_url").agg(F.sum("n").alias("n"), best.alias("best"))
    return merged.select(
        F.col("row_key").alias(key),
        F.col("row_url").alias("url"),
        host_of(F.col("row_url")).alias("host"),
        path_of(F.col("row_url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"),
    ).drop("copy")
