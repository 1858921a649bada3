"""The stages, one by one, on a small corpus with known cases."""

import os

import pytest

import corpus_pipeline
from metalith.llm import line_dedup
from metalith.llm.shared import settle


def corpus(spark):
    clean = [" ".join(f"d{i}w{k * 7 % 90}x{k}" for k in range(80)) for i in range(40)]
    rows = [(i, t + "\nshared footer line of every site", "en", f"src{i % 12}", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[0] + " edited", "en", "src1", 1), (101, clean[1], "en", "src2", 1), (102, "too short", "en", "src3", 9), (103, "spam spam spam " * 40, "en", "src4", 1), (104, None, "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs = corpus(spark)
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, str(tmp_path)))
        seen.append(docs)
    quality, lines, near, mixed, encoded = seen
    assert all(x.columns == columns for x in seen[:-1])
    assert {r["doc_id"] for r in quality.collect()} == {*range(40), 100, 101}
    assert lines.count() == quality.count() and lines.where("text LIKE '%shared footer%'").count() == 0
    assert lines.where("n_chars <> length(text)").count() == 0
    assert {r["doc_id"] for r in near.collect()} == set(range(40))
    assert {r["doc_id"] for r in mixed.collect()} <= set(range(40)) and mixed.count() >= 30
    assert encoded.where("n_tokens <> size(ids) OR n_tokens = 0").count() == 0 and encoded.count() == mixed.count()


def test_run(spark, tmp_path):
    os.makedirs(tmp_path / "sf")
    corpus(spark).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).count() >= 30


def test_run_matches_plain(spark, tmp_path):
    """Every row of the pipeline, against the plain versions of its stages one after another; columns that clash with inner ones, a very long text and empty ones."""
    import base64
    import collections
    import random

    import public_tokenizers
    import tiktoken

    from metalith.llm.queries import VOCABULARY
    from tests.llm import plain

    r = random.Random(41)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(900)]
    texts = ["\n".join(" ".join(r.choice(words) for _ in range(15)) for _ in range(6)) for _ in range(70)]
    rows = [(i, t + ("\nthe same footer of all sites" if i % 3 else ""), f"s{i % 14}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i] + " and an edit", f"s{i}") for i in range(6)] + [(200 + i, texts[40], f"s{i}") for i in range(12)]
    rows += [(300, "too short", "s1"), (301, None, None), (302, "", "s2"), (303, "spam spam spam " * 50, "s3"), (304, " ".join(f"w{k}" for k in range(60000)), "s4"), (305, "# $ % & " * 90, "s5")]
    rows.sort(key=lambda x: r.random())
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ["ids", "n_tokens", "copies", "mark", "did", "_m0", "component", "words", "key"]
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], schema).selectExpr("*", *[f"'{c}' AS {c}" for c in clash])
    os.makedirs(tmp_path / "sf")
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    left = plain.one_of_each_group(plain.without_boilerplate([x for x in rows if plain.good(x[1])]))
    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for (d, t, s), n in zip(left, plain.copies(left, 0.97, 4.0)):
        want[d, s, t, tuple(own.encode_ordinary(t))] += n
    got = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    assert collections.Counter((x["doc_id"], x["source"], x["text"], tuple(x["ids"])) for x in got) == +want
    assert len(left) > 60 and {x["lang"] for x in got} == {"en"} and all(x["n_tokens"] == len(x["ids"]) for x in got)


def test_empty_corpus(spark, tmp_path):
    os.makedirs(tmp_path / "sf")
    corpus(spark).limit(0).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).count() == 0


@pytest.mark.parametrize("broadcast", [line_dedup.BROADCAST_LINES, 0])
def test_copied_text_stays_once(spark, monkeypatch, broadcast):
    """A clean text on 12 sites isn't boilerplate; a footer of 12 different texts is, also where they were copied."""
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    clean = "\n".join(" ".join(f"c{k}x{j}" for j in range(12)) for k in range(8))
    rows = [(i, clean + " \n" * (i % 2), "en", f"src{i}", 1) for i in range(12)] + [(None, clean, "en", None, 1)]
    other = [" ".join(f"d{i}w{k}" for k in range(60)) for i in range(12)]
    rows += [(100 + 20 * k + i, t + "\na footer of all", "en", f"src{i}", 1) for i, t in enumerate(other) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = settle(corpus_pipeline.lines(spark, docs, ""))
    assert lines.count() == len(rows) and lines.where("trim(text) = ''").count() == 0
    near = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_duplicates(spark, lines.where("doc_id IS NOT NULL"), "").collect()}
    assert near == {0: clean} | {100 + i: t for i, t in enumerate(other)}


def test_long_document_passes_the_quality_rules(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long").selectExpr("doc_id", "CASE doc_id WHEN 1 THEN array_join(transform(sequence(1, 1000001), x -> concat('w', x)), ' ') ELSE 'too short' END AS text")
    assert [r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, "").select("doc_id").collect()] == [1]
