"""Byte-level BPE, encoded and decoded by DuckDB queries inside each task.

A text is split by the tokenizer's pattern. A piece that is itself in the vocabulary is one
token. Every other distinct piece starts as rows (word, token position, token), a row a byte,
and a recursive query contracts, in each step and word, the leftmost pair of least rank: rows meet
the merge table on (token, next token), the least (rank, position) of each word wins and is
replaced, until no pair of the word joins; the rows of a word's last step are its tokens.
Decoding joins token positions with the vocabulary and concatenates by an ordered aggregate.

Merge table: every split of a vocabulary entry into two entries, ranked by the whole;
so the pair of least rank is the one the vocabulary's own encoder would take.

Long words. A step contracts one pair of a word, so a word of n bytes takes up to n steps over n
rows. Words are therefore cut into segments of ``SEGMENT`` bytes (one for all but the longest words), which are
contracted as words and joined pairwise, all words of a call together. A join rests on this: a sequence of tokens is what
its bytes are contracted to if and only if each two neighbours are what their own bytes are contracted to,
because the least pair of the whole, where it lies between these two, is the least of the two. So the two tokens at a seam
are contracted by the same query; where they don't stay as they are, the tokens around the seam are contracted
as one word, and the seams that this makes are looked at in turn.

Memory: a batch of words is bounded by the sum of their squared lengths, which bounds the rows of all steps; pieces are
remembered per worker in two generations of ``REMEMBERED`` each, of which the older one is dropped but for the pieces that are met again; texts are taken ``CHUNK_CHARS`` at a time, or one longer text; a long
sequence of ids is decoded in parts.

Defined cases: a null text is empty, and an empty text has no tokens; special tokens are
ordinary text; repeated rows are encoded each on their own; texts are encoded whole; null ids decode to an empty
text; an unknown id, or a null among the ids, raises; columns of the input pass through, but for those
that have the name of a result, whatever their case.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from metalith.llm.shared import kept_by_worker, lean

SEGMENT = 64
#: Tokens on each side of a seam that are contracted anew.
AROUND = 4
BATCH_SQUARES = 1 << 22
REMEMBERED = 200_000
CHUNK_CHARS = 1 << 20
DECODE_TOKENS = 1 << 19

CONTRACT = """
WITH RECURSIVE t(step, word, pos, id) AS (
  SELECT 0, word, pos, id FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT word, pos, id, lead(pos) OVER o AS next_pos, lead(id) OVER o AS next_id, lead(word) OVER o AS next_word FROM t WINDOW o AS (ORDER BY pos)),
   best AS (
     SELECT word, min(merged::BIGINT << 32 | pos) AS won, arg_min(next_pos, merged::BIGINT << 32 | pos) AS gone
     FROM pairs JOIN merges ON l = id AND r = next_id WHERE word = next_word GROUP BY word)
   SELECT step + 1, word, pos, CASE WHEN pos = won & 4294967295 THEN won >> 32 ELSE id END FROM t JOIN best USING (word) WHERE pos <> gone))
SELECT word, id FROM t JOIN (SELECT word, max(step) AS step FROM t GROUP BY word) USING (word, step) ORDER BY pos
"""
DECODE = "SELECT part, string_agg(v.chars, '' ORDER BY pos) AS chars, count(*) - count(v.id) AS unknown FROM tokens LEFT JOIN vocabulary v USING (id) GROUP BY part"


def groups(sizes, most: int):
    """(from, to) of runs whose sizes add up to at most ``most``, or of one that is larger."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


class Coder:
    """The tables of one vocabulary in a DuckDB connection of this worker, and the pieces it remembers."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.seams: dict[tuple[int, int], bool] = {}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        columns = np.array(pairs, np.int32).reshape(-1, 3)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.load("merges", {"l": columns[:, 0], "r": columns[:, 1], "merged": columns[:, 2]})
        # bytes as the characters of the same number, so that any bytes can be aggregated as text
        self.load("vocabulary", {"id": np.array(list(self.ranks.values()), np.int32), "chars": [t.decode("latin-1") for t in self.ranks]})

    def load(self, name: str, columns: dict) -> None:
        self.db.register("loading", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM loading")
        self.db.unregister("loading")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, contracted as a whole, as little-endian 32-bit numbers."""
        out: list[bytes] = []
        for lo, hi in groups([len(w) ** 2 for w in words], BATCH_SQUARES):
            part = words[lo:hi]
            body = np.frombuffer(b"".join(part), np.uint8)
            word = np.repeat(np.arange(len(part), dtype=np.int32), [len(w) for w in part])
            self.db.register("start", pa.table({"word": word, "pos": np.arange(len(body), dtype=np.int32), "id": self.single[body]}))
            found = self.db.sql(CONTRACT).to_arrow_table()
            self.db.unregister("start")
            ids = found.column("id").to_numpy().astype("<u4").tobytes()
            cut = (4 * np.searchsorted(found.column("word").to_numpy(), np.arange(len(part) + 1))).tolist()
            out += [ids[a:b] for a, b in zip(cut, cut[1:])]
        return out

    def lists(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of each distinct word."""
        distinct = list(set(words))
        return {w: np.frombuffer(x, "<u4").tolist() for w, x in zip(distinct, self.contract(distinct))}

    def contract_cut(self, words: list[bytes]) -> list[bytes]:
        """The same for words of any length, by their segments."""
        parts = [[w[i : i + SEGMENT] for i in range(0, len(w), SEGMENT)] for w in words]
        ids = self.lists([s for p in parts for s in p])
        lists = [[list(ids[s]) for s in p] for p in parts]
        while any(len(x) > 1 for x in lists):
            self.join([(x[i], x[i + 1]) for x in lists for i in range(0, len(x) - 1, 2)])
            lists = [x[::2] for x in lists]
        return [np.array(x[0], "<u4").tobytes() for x in lists]

    def stay(self, seams: set[tuple[int, int]]) -> None:
        """Learn whether these neighbours stay as they are."""
        new = [s for s in seams if s not in self.seams]
        if len(self.seams) > REMEMBERED:
            self.seams.clear()
            new = list(seams)
        for (a, b), ids in zip(new, self.contract([self.bytes_of[a] + self.bytes_of[b] for a, b in new])):
            self.seams[a, b] = ids == np.array([a, b], "<u4").tobytes()

    def join(self, pairs: list[tuple[list[int], list[int]]]) -> None:
        """Append to the first list of each pair what the second makes of it."""
        open_ = [(a, b, 0, AROUND) for a, b in pairs]  # first, second, tokens taken from it, tokens given back by the first
        while open_:
            self.stay({(a[-1], b[at]) for a, b, at, _ in open_})
            torn = []
            for a, b, at, back in open_:
                if self.seams[a[-1], b[at]]:
                    a.extend(b[at:])
                else:
                    torn.append((a, b, at, back))
            words = [b"".join(self.bytes_of[t] for t in a[-back:] + b[at : at + AROUND]) for a, b, at, back in torn]
            anew = self.lists(words)
            made = [anew[w] for w in words]
            self.stay({(a[-back - 1], m[0]) for (a, _, _, back), m in zip(torn, made) if len(a) > back})
            open_ = []
            for (a, b, at, back), m in zip(torn, made):
                if len(a) > back and not self.seams[a[-back - 1], m[0]]:
                    open_.append((a, b, at, 2 * back))
                    continue
                a[-back:] = m
                if at + AROUND < len(b):
                    open_.append((a, b, at + AROUND, AROUND))

    def learn(self, pieces: set[str]) -> None:
        words = {p: p.encode("utf-8", "surrogatepass") for p in pieces}
        self.seen.update((p, self.ranks[w].to_bytes(4, "little")) for p, w in words.items() if w in self.ranks)
        for contract, some in ((self.contract, [p for p, w in words.items() if len(w) <= SEGMENT and w not in self.ranks]), (self.contract_cut, [p for p, w in words.items() if len(w) > SEGMENT and w not in self.ranks])):
            self.seen.update(zip(some, contract([words[p] for p in some])))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        out = []
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
        for lo, hi in groups(sizes, CHUNK_CHARS):
            pieces = [self.split(t or "") for t in texts.slice(lo, hi - lo).to_pylist()]
            distinct = set().union(*pieces)
            if len(self.seen) > REMEMBERED:
                self.seen, self.older = {}, self.seen
            new = distinct.difference(self.seen)
            again = new.intersection(self.older)
            self.seen.update((p, self.older[p]) for p in again)
            self.learn(new - again)
            get = self.seen.__getitem__
            out += [b"".join(map(get, p)) for p in pieces]
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each sequence of ids."""
        step = 4 * DECODE_TOKENS
        parts = [(i, at) for i, x in enumerate(ids) for at in range(0, len(x), step)]
        out = [[] for _ in ids]
        for lo, hi in groups([min(step, len(ids[i]) - at) for i, at in parts], step):
            bodies = [ids[i][at : at + step] for i, at in parts[lo:hi]]
            size = [len(x) // 4 for x in bodies]
            flat = np.frombuffer(b"".join(bodies), "<u4").astype(np.int64)
            self.db.register("tokens", pa.table({"part": np.repeat(np.arange(len(bodies), dtype=np.int32), size), "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
            found = sorted(self.db.sql(DECODE).fetchall())
            self.db.unregister("tokens")
            if any(unknown for _, _, unknown in found):
                raise ValueError("unknown token id")
            for (i, _), (_, chars, _) in zip(parts[lo:hi], found):
                out[i].append(chars.encode("latin-1"))
        return [b"".join(x) for x in out]


def coder(ranks_file: bytes, pattern: str) -> Coder:
    """One coder a worker and vocabulary."""
    return kept_by_worker(hashlib.sha256(ranks_file + pattern.encode()).digest(), lambda: Coder(ranks_file, pattern))


def without(docs: DataFrame, *names: str):
    """The fields of ``docs`` but for those of these names."""
    taken = {n.lower() for n in names}
    return [f for f in docs.schema.fields if f.name.lower() not in taken]


def ddl_of(fields, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *more])


def packed(ids: list[list[int] | None]) -> list[bytes]:
    if any(x is not None and None in x for x in ids):
        raise ValueError("unknown token id")
    return [np.array(x or [], "<u4").tobytes() for x in ids]


class Tokenizer:
    """A vocabulary of ranks and its pattern; the file (a megabyte, whatever the corpus) is broadcast to the workers."""

    def __init__(self, spark, path: str, pattern: str):
        with open(path, "rb") as f:
            self.file = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern

    def encode(self, docs: DataFrame, text: str = "text", decoded: str | None = None) -> DataFrame:
        """``docs`` without the text, with n_tokens and ids (array of int); with ``decoded`` also a column of that name: the text that the ids decode to."""
        file, pattern = self.file, self.pattern
        rest = without(docs, text, "n_tokens", "ids", *([decoded] if decoded else []))
        names = [f.name for f in rest]

        def run(batches):
            c = coder(file.value, pattern)
            for batch in batches:
                ids = c.encode(batch.column(len(names)))
                cut = np.append(0, np.cumsum([len(x) // 4 for x in ids])).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                columns = [*batch.columns[: len(names)], pa.array(np.diff(cut).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), values)]
                if decoded:
                    columns.append(pa.array([x.decode() for x in c.decode(ids)], pa.string()))
                yield pa.record_batch(columns, names=[*names, "n_tokens", "ids", *([decoded] if decoded else [])])

        ddl = ddl_of(rest, "n_tokens long", "ids array<int>", *([f"`{decoded}` string"] if decoded else []))
        return docs.select(*[f"`{n}`" for n in names], docs[f"`{text}`"].cast("string")).mapInArrow(lean(run, keep=True), ddl)

    def decode(self, tokens: DataFrame, ids: str = "ids", to: str = "text") -> DataFrame:
        """``tokens`` with the decoded bytes in place of the ids."""
        file, pattern = self.file, self.pattern
        rest = without(tokens, ids, to)
        names = [f.name for f in rest]

        def run(batches):
            c = coder(file.value, pattern)
            for batch in batches:
                done = c.decode(packed(batch.column(len(names)).to_pylist()))
                yield pa.record_batch([*batch.columns[: len(names)], pa.array(done, pa.binary())], names=[*names, to])

        return tokens.select(*[f"`{n}`" for n in names], f"`{ids}`").mapInArrow(lean(run, keep=True), ddl_of(rest, f"`{to}` binary"))

    def digests(self, docs: DataFrame) -> DataFrame:
        """Per row: doc_id, n_tokens and the hashes of its ids and of what they decode to."""
        file, pattern = self.file, self.pattern
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

        def run(batches):
            c = coder(file.value, pattern)
            for batch in batches:
                ids = c.encode(batch.column("text"))
                digest = [hashlib.sha256(x).hexdigest() for x in ids]
                decoded = [hashlib.sha256(x).hexdigest() for x in c.decode(ids)]
                yield pa.record_batch([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(digest), pa.array(decoded)], schema=schema)

        narrow = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
        return narrow.mapInArrow(lean(run, keep=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
