"""Byte-level BPE by rank file: DuckDB recursive queries inside Spark's tasks encode, ordered aggregation decodes.

Each task splits its texts by the pattern and keeps the distinct words that its memory lacks. Their bytes become
token-position rows. One recursive query joins neighbours with the merge table, contracts the leftmost pair of
minimum rank of every word, and goes on until no word has a pair left. Words beyond ``LONG`` bytes would
take as many rounds as bytes; they are merged by the same rule with a heap.

Defined cases: a null or empty text has no ids and decodes to no bytes; every text is processed whole; equal
texts, repeated rows and null identifiers pass through row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitrine.llm.common import steps, tidy
from vitrine.llm.pieces import PartCoder, narrowest

LONG = 128
#: Words per recursive query and tokens per decoding query: they bound memory only.
WORDS, TOKENS = 15_000, 400_000

#: Parts of text that a task remembers; beyond it the memory starts anew.
REMEMBERED = 400_000

ROUNDS = """
CREATE OR REPLACE TEMP TABLE rounds AS
WITH RECURSIVE step(word, pos, tok, nxt, npos, key, round) AS (
  SELECT s.word, s.pos, s.tok, s.nxt, s.npos, (m.merged::BIGINT << 32) | (s.pos << 16) | s.npos, 0
  FROM start s LEFT JOIN merges m ON m.l = s.tok AND m.r = s.nxt
  UNION ALL (
  WITH best AS MATERIALIZED (
    SELECT word, min(key) AS key FROM step GROUP BY word HAVING min(key) IS NOT NULL),
  pair AS MATERIALIZED (
    SELECT b.word, (b.key >> 32)::INT AS merged, ((b.key >> 16) & 65535)::INT AS p, (b.key & 65535)::INT AS q,
      s.nxt AS after, s.npos AS after_pos
    FROM best b JOIN step s ON s.word = b.word AND s.pos = (b.key & 65535)::INT),
  moved AS (
    SELECT s.word, s.pos, CASE WHEN s.pos = a.p THEN a.merged ELSE s.tok END AS tok,
      CASE WHEN s.pos = a.p THEN a.after WHEN s.npos = a.p THEN a.merged ELSE s.nxt END AS nxt,
      CASE WHEN s.pos = a.p THEN a.after_pos ELSE s.npos END AS npos, s.round + 1 AS round
    FROM step s JOIN pair a ON a.word = s.word WHERE s.pos <> a.q)
  SELECT v.word, v.pos, v.tok, v.nxt, v.npos, (m.merged::BIGINT << 32) | (v.pos << 16) | v.npos, v.round
  FROM moved v LEFT JOIN merges m ON m.l = v.tok AND m.r = v.nxt))
SELECT word, pos, tok, round FROM step"""
FIXPOINT = """
SELECT r.word, r.tok FROM rounds r JOIN (SELECT word, max(round) AS round FROM rounds GROUP BY word) l
  ON l.word = r.word AND l.round = r.round ORDER BY r.word, r.pos"""
DECODE = """
SELECT doc, string_agg(v.body, '' ORDER BY t.pos) AS body FROM tokens t JOIN vocabulary v ON v.tok = t.tok GROUP BY doc"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Leftmost pair of minimum rank first, by a heap over linked parts."""
    end, n = list(range(1, len(word) + 1)), len(word)
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(word[i:end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if gone[i] or j >= n or end[j] != stop:
            continue
        gone[j], end[i] = 1, stop
        if stop < n:
            before[stop] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i:end[i]]] for i in range(n) if not gone[i]]


class Bpe:
    """Encoder and decoder of one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks, self.words_of = ranks, regex.compile(pattern).findall
        self.type = narrowest(max(ranks.values()) + 1)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        pairs = [(left, right, rank) for token, rank in ranks.items() for i in range(1, len(token))
                 if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None]
        columns = list(zip(*pairs)) or [(), (), ()]
        self._table("merges", pa.table([pa.array(c, pa.int32()) for c in columns], names=["l", "r", "merged"]))
        self._table("vocabulary", pa.table({
            "tok": pa.array(list(ranks.values()), pa.int32()),
            "body": pa.array([t.decode("latin-1") for t in ranks], pa.string())}))
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.encode = PartCoder(self._parts, REMEMBERED)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _parts(self, one: list[str], other: list[str]) -> Iterator[tuple[str, bytes]]:
        split = [self.words_of(p) for p in other]
        self.known = {}
        self._learn(sorted({w for words in split for w in words}.union(one)))
        find = self.known.__getitem__
        yield from zip(one, map(find, one))
        yield from ((p, b"".join(map(find, words))) for p, words in zip(other, split))

    def _learn(self, words: list[str]) -> None:
        rows: list[tuple[str, bytes]] = []
        for word in words:
            body = word.encode()
            rank = self.ranks.get(body)
            if rank is not None:
                self.known[word] = np.array([rank], self.type).tobytes()
            elif len(body) > LONG:
                self.known[word] = np.array(merge_long(body, self.ranks), self.type).tobytes()
            else:
                rows.append((word, body))
        for at in range(0, len(rows), WORDS):
            self._contract(rows[at:at + WORDS])

    def _contract(self, rows: list[tuple[str, bytes]]) -> None:
        buffer = np.frombuffer(b"".join(body for _, body in rows), np.uint8)
        sizes = np.array([len(body) for _, body in rows])
        first = np.cumsum(sizes) - sizes
        last = np.zeros(len(buffer), bool)
        last[first + sizes - 1] = True
        pos = (np.arange(len(buffer)) - np.repeat(first, sizes)).astype(np.int32)
        tok = self.byte[buffer]
        self.db.register("start", pa.table({
            "word": np.repeat(np.arange(len(rows), dtype=np.int32), sizes), "pos": pos, "tok": tok,
            "nxt": np.where(last, -1, np.append(tok[1:], -1)).astype(np.int32),
            "npos": np.where(last, -1, pos + 1).astype(np.int32)}))
        self.db.execute(ROUNDS)
        self.db.unregister("start")
        got = self.db.execute(FIXPOINT).fetchnumpy()
        ends = np.cumsum(np.bincount(got["word"], minlength=len(rows)))
        body, size, at = got["tok"].astype(self.type).tobytes(), np.dtype(self.type).itemsize, 0
        for (word, _), end in zip(rows, ends.tolist()):
            self.known[word] = body[at * size:end * size]
            at = end

    def decode(self, documents: Sequence[np.ndarray]) -> list[bytes]:
        """The bytes of each id array; a long array is decoded in parts."""
        out: list[list[bytes]] = [[] for _ in documents]
        held: list[tuple[int, np.ndarray]] = []
        room = TOKENS
        for i, ids in enumerate(documents):
            for at in range(0, len(ids), TOKENS):
                part = ids[at:at + TOKENS]
                if len(part) > room:
                    self._flush(held, out)
                    held, room = [], TOKENS
                held.append((i, part))
                room -= len(part)
        self._flush(held, out)
        return [b"".join(parts) for parts in out]

    def _flush(self, held: list[tuple[int, np.ndarray]], out: list[list[bytes]]) -> None:
        if not held:
            return
        tok = np.concatenate([ids for _, ids in held]).astype(np.int32)
        self.db.register("tokens", pa.table({
            "doc": np.repeat(np.arange(len(held), dtype=np.int32), [len(ids) for _, ids in held]),
            "pos": np.arange(len(tok), dtype=np.int32), "tok": tok}))
        for k, body in sorted(self.db.execute(DECODE).fetchall()):
            out[held[k][0]].append(body.encode("latin-1"))
        self.db.unregister("tokens")

    def round_trip(self, texts: Sequence[str]) -> list[tuple[np.ndarray, bytes]]:
        """Ids of each text and their bytes again."""
        ids = [np.frombuffer(b, self.type) for b in self.encode(texts)]
        return list(zip(ids, self.decode(ids)))


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", key: str = "doc_id",
                  bodies: bool = True) -> DataFrame:
    """One row per document: ``key``, n_tokens, ids_sha256, decoded_sha256 and, with ``bodies``, the ids as
    little-endian unsigned 32-bit integers (``ids``) and the decoded bytes (``decoded``).

    ``rank_file`` is a path that every executor has, as part of its installed packages.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch, texts in steps(batches):
            coder = coder or Bpe(read_ranks(rank_file), pattern)
            pairs = [(ids.astype("<u4").tobytes(), body) for ids, body in coder.round_trip(texts)]
            columns = [batch.column("key"), pa.array([len(i) // 4 for i, _ in pairs], pa.int64()),
                       pa.array([hashlib.sha256(i).hexdigest() for i, _ in pairs], pa.string()),
                       pa.array([hashlib.sha256(b).hexdigest() for _, b in pairs], pa.string())]
            if bodies:
                columns += [pa.array([i for i, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * bodies]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        tidy(run), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
        + ", ids binary, decoded binary" * bodies)
