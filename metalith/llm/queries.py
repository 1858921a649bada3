"""The operators as queries over whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metalith.llm import bpe, html_main, line_dedup, lz_fingerprint, mixing, near_dup, quality, substrings, suffix_array, url_rules
from metalith.llm.shared import table

QUERIES = {}
ORACLE_SQL = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


#: The rules of the url query.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]

OP1_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    row_number() OVER () AS row_id
  FROM pages),
r(rule, rhost, rpath, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
m AS (
  SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY p.row_id ORDER BY length(r.rule) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, url, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


@query("op1_url_filters", OP1_SQL)
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_rules.apply_rules(table(spark, sf_dir, "pages"), rules)


OP9_MEASURES_SQL = r"""
  WITH w AS (
    SELECT *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
      row_number() OVER () AS row_id
    FROM documents),
  g AS (
    SELECT row_id, unnest(range(len(words) - 2)) AS i, words FROM w WHERE len(words) >= 3),
  h AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, words[i + 1], words[i + 2], words[i + 3]) AS n FROM g),
  c AS (SELECT row_id, count(DISTINCT i + d) AS n_repeat_words FROM h, (VALUES (0), (1), (2)) t(d) WHERE n >= 2 GROUP BY row_id),
  m AS (
    SELECT w.*, CAST(len(words) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      CAST(len(lines) AS BIGINT) AS n_lines,
      CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN c USING (row_id)),
  b AS (
    SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
      + CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
      + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 32 ELSE 0 END
      + CASE WHEN n_lines > 1 AND 10 * n_dup_lines > 7 * n_lines THEN 64 ELSE 0 END AS BIGINT) AS failed_bits
    FROM m)
"""
OP9_SQL = OP9_MEASURES_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 127) = 0 AS kept, failed_bits FROM b
"""


@query("op9_quality_rules", OP9_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(words[i + 1 : i + 13], ' ') AS g FROM (SELECT *, unnest(range(len(words) - 12)) AS i FROM w WHERE len(words) >= 13)),
f AS (SELECT rid, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE least < doc_id),
c AS (SELECT DISTINCT rid, i + d AS at FROM f, range(13) t(d)),
k AS (
  SELECT w.rid, any_value(w.doc_id) AS doc_id, count(u.word) AS n_words, count(c.at) AS n_removed,
    coalesce(string_agg(u.word, ' ' ORDER BY u.at) FILTER (WHERE c.at IS NULL), '') AS kept
  FROM w LEFT JOIN (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS at FROM w) u ON u.rid = w.rid
  LEFT JOIN c ON c.rid = u.rid AND c.at = u.at GROUP BY w.rid)
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM k
"""


@query("op4_substring_dedup", OP4_SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


#: Bytes as two hex digits; windows are grouped by a 128-bit digest of them.
OP8_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT rid, doc_id, i, md5_number(substring(h, 2 * i + 1, 200)) AS g FROM (SELECT *, unnest(range(length(h) // 2 - 99)) AS i FROM w WHERE length(h) >= 200)),
f AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
s AS (SELECT rid, i, coalesce(i > lag(i) OVER o + 100, true) AS starts FROM f WINDOW o AS (PARTITION BY rid ORDER BY i)),
n AS (SELECT rid, i, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS span FROM s),
r AS (SELECT rid, span, min(i) AS lo, max(i) + 100 AS hi FROM n GROUP BY rid, span),
e AS (SELECT rid, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY rid ORDER BY lo) AS before FROM r),
k AS (
  SELECT w.rid, any_value(doc_id) AS doc_id, any_value(length(h) // 2) AS n_bytes, coalesce(sum(hi - lo), 0) AS n_removed, count(lo) AS n_spans,
    coalesce(string_agg(substring(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo), '') || substring(any_value(h), 2 * coalesce(max(hi), 0) + 1) AS kept
  FROM w LEFT JOIN e ON e.rid = w.rid GROUP BY w.rid)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k
"""


@query("op8_suffix_array_dedup", OP8_SQL)
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(table(spark, sf_dir, "documents"))


@query("op5_lz_fingerprints")
def op5_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(words[i + 1 : i + 5], ' ') FOR i IN range(greatest(len(words) - 4, CASE WHEN len(words) > 0 THEN 1 ELSE 0 END))]) AS shingles FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(shingles) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b) SELECT * FROM r)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""


@query("op3_near_dedup", OP3_SQL)
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.group_near(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, text, source FROM documents),
l AS (SELECT rid, doc_id, coalesce('s' || source, '') AS site, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key
  FROM (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM t)),
b AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= 10),
k AS (
  SELECT rid, count(*) FILTER (WHERE l.key <> '') AS n_lines, count(b.key) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.key IS NULL) AS kept
  FROM l LEFT JOIN b ON b.key = l.key GROUP BY rid)
SELECT t.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (rid)
"""


@query("op7_line_dedup", OP7_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cleaned = line_dedup.remove_boilerplate(docs, counts=True)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.copies(docs).select("doc_id", "source", "n_tokens", "copies")


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def tokenizer(spark: SparkSession) -> bpe.Tokenizer:
    import public_tokenizers

    return bpe.Tokenizer(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer(spark).digests(table(spark, sf_dir, "documents"))


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))
