"""Document fingerprints: SimHash, and search by permuted block tables.

Every distinct word of a text casts its hash's 64 bits as signed votes, weighted by 1 + log of its count; bit k
of the fingerprint is set if the votes for it are positive. Equal texts have equal fingerprints.

Search: 64 bits are cut into ``blocks`` parts. Two fingerprints that differ in at most ``radius`` bits agree in at
least ``blocks - radius`` parts, so one table for each choice of that many parts, keyed by their bits, finds every
such pair; the distance is then counted exactly. Equal fingerprints count as one entry of the tables, so a
group of copies of any size costs one.

``count_within`` needs no pairs: a task reads a table's entries in order of their key and compares those of one key among
each other; a pair counts only in the first of the tables in which it meets. So a large group of near copies costs
comparisons but no rows; one of more than ``TILE`` fingerprints is cut by the same rule once more, into the parts of the bits
that its key leaves open.

The edited text of a document takes text from the next one in descending id. Documents are range-partitioned
and sorted by id once. Within a partition the next one simply follows; the last of each partition meets the first
of the following one in a second, small step over at most two texts per partition.

Defined cases: a null or empty text has fingerprint 0; null identifiers come last; rows of one id are ordered by
text; after the last document follows the first, which is itself if it is alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.llm.common import steps, tasks_of, tidy
from vitrine.shared import run_folder, write_out

#: Hashes of words that a task remembers at most.
REMEMBERED = 500_000


class Words(dict):
    """Word to hash, computed once."""

    def __missing__(self, word: str) -> int:
        import xxhash
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return value


def fingerprint(text: str, words: Words) -> int:
    """A signed 64-bit number."""
    seen = Counter(text.lower().split())
    if not seen:
        return 0
    hashes = np.fromiter(map(words.__getitem__, seen), np.uint64, len(seen))
    weight = 1 + np.log(np.fromiter(seen.values(), np.float32, len(seen)))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(weight @ bits * 2 > weight.sum()).view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and its fingerprint as a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch, texts in steps(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([fingerprint(t, words) for t in texts], pa.int64())],
                names=[key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        run, f"`{key}` {kind}, fingerprint long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_keys(value: Column, radius: int, blocks: int) -> Column:
    """One (table, key) per choice of ``blocks - radius`` parts."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for table, parts in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in parts)
        keys.append(F.struct(F.lit(table).alias("table"),
                             value.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*keys)


def within(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs of a query's fingerprint and an indexed one within the radius: fingerprint, other, distance.

    Both inputs have a column ``fingerprint``; each distinct value counts once. Join them back for identifiers.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be less than blocks")
    side = lambda df, name: df.select(F.col("fingerprint").alias(name)).where(
        F.col(name).isNotNull()).distinct().select(name, F.explode(block_keys(F.col(name), radius, blocks)).alias("k"))
    pairs = side(queries, "fingerprint").join(side(index, "other"), "k")
    return pairs.where(distance(F.col("fingerprint"), F.col("other")) <= radius).select(
        "fingerprint", "other").distinct().withColumn("distance", distance(F.col("fingerprint"), F.col("other")))


TILE = 2_048


def _first_tables(radius: int, blocks: int) -> np.ndarray:
    """By the set of equal blocks (as bits): the first table whose parts are all among them, or -1."""
    tables = list(combinations(range(blocks), blocks - radius))
    out = np.full(1 << blocks, -1)
    for equal in range(1 << blocks):
        out[equal] = next((t for t, parts in enumerate(tables) if all(equal >> k & 1 for k in parts)), -1)
    return out


def _masks(bits: list[int], parts: int) -> list[np.uint64]:
    """The given bits dealt into as many masks, in order."""
    edges = [len(bits) * k // parts for k in range(parts + 1)]
    return [np.uint64(sum(1 << b for b in bits[x:y])) for x, y in zip(edges, edges[1:])]


def near_in_group(values: np.ndarray, radius: int, fits) -> np.ndarray:
    """For each of the distinct values, how many others lie within the radius and fulfil ``fits`` (of the differing bits).

    All lie side by side up to ``TILE``. Beyond, values within the radius agree in one of radius + 1 parts of the bits that
    vary; each part's runs are compared, and a pair counts where it first agrees.
    """
    counts = np.zeros(len(values), np.int64)
    varying = int(np.bitwise_or.reduce(values ^ values[0]))
    if len(values) <= TILE or varying.bit_count() <= radius:  # a few bits make few values
        for i in range(0, len(values), 256):
            x = values[i:i + 256, None] ^ values[None, :]
            near = (np.bitwise_count(x) <= radius) & (x != 0) & fits(x)
            counts[i:i + 256] = near.sum(axis=1)
        return counts
    masks = _masks([b for b in range(64) if varying >> b & 1], radius + 1)
    for k, mask in enumerate(masks):
        key = values & mask
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for run in np.split(order, cuts):
            if len(run) > 1:
                first = lambda x, k=k: np.logical_and.reduce([x & m != 0 for m in masks[:k]]) if k else np.True_
                # a run that is still large varies in fewer bits, unless all of them are equal
                counts[run] += near_in_group(values[run], radius, lambda x, first=first: fits(x) & first(x))
    return counts


def count_within(index: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """For each distinct ``fingerprint`` that has any: the number of other distinct ones within the radius, ``near``."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be less than blocks")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:])]
    first = _first_tables(radius, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64),) * 3  # entries of the last key, which the next batch may go on with
        for batch in batches:
            columns = [batch.column(c).to_numpy().astype(np.int64) for c in ("table", "bits", "fingerprint")]
            held = tuple(np.concatenate(pair) for pair in zip(held, columns))
            if len(held[0]):
                new = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                stop = new[-1] + 1 if len(new) else 0
                yield counted(*(x[:stop] for x in held))
                held = tuple(x[stop:] for x in held)
        yield counted(*held)

    def counted(table: np.ndarray, bits: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((np.diff(table) != 0) | (np.diff(bits) != 0)) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(table))
        values, found = [], []
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b - a > 1:
                own = value[a:b].view(np.uint64)
                equal = lambda x: sum((x & m == 0).astype(np.int64) << k for k, m in enumerate(masks))
                n = near_in_group(own, radius, lambda x, t=table[a]: first[equal(x)] == t)
                values.append(value[a:b][n > 0])
                found.append(n[n > 0])
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (values, found)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flat], names=["fingerprint", "near"])

    entries = index.select("fingerprint").where("fingerprint is not null").distinct().select(
        "fingerprint", F.explode(block_keys(F.col("fingerprint"), radius, blocks)).alias("k")).select("k.table", "k.bits", "fingerprint")
    ordered = entries.repartition(tasks_of(index.sparkSession), "table", "bits").sortWithinPartitions("table", "bits")
    return ordered.mapInArrow(tidy(run), "fingerprint long, near long").groupBy("fingerprint").agg(F.sum("near").alias("near"))


_FIELDS = {"doc_id": "long", "n_chars": "long", "edited_sha256": "string", "own": "long", "edited": "long",
           "following": "long", "part": "long", "edge": "string", "text": "string"}
_TYPES = {"long": pa.int64(), "string": pa.string()}


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _TYPES[kind]) for c, kind in zip(columns, _FIELDS.values())], names=list(_FIELDS))


def _pair(doc_id: int | None, text: str, following: str, own: int, other: int, words: Words) -> tuple:
    n = len(text)
    edited = text[:n - n // 2] + following[:n // 2]
    return (doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), own, fingerprint(edited, words), other, None, None, None)


def with_edited(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_chars, edited_sha256 and the fingerprints ``own``, ``edited``, ``following`` of every document; and all
    documents' fingerprints as a written table."""
    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, held = Words(), TaskContext.get().partitionId(), None
        for batch, texts in steps(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                own = fingerprint(text, words)
                if held is None:
                    out.append((doc_id, None, None, own, None, None, part, "first", text))
                else:
                    out.append(_pair(held[0], held[1], text, held[2], own, words))
                held = doc_id, text, own
            yield _rows(out)
        if held is not None:
            yield _rows([(held[0], None, None, held[2], None, None, part, "last", held[1])])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            yield _rows([_pair(r["doc_id"], r["text"], r["next_text"], r["own"], r["next_own"], words)
                         for r in batch.to_pylist()])

    schema = ", ".join(f"{name} {kind}" for name, kind in _FIELDS.items())
    order = (F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    ordered = docs.select("doc_id", "text").repartitionByRange(
        tasks_of(docs.sparkSession), *order).sortWithinPartitions(*order, "text")
    written = write_out(ordered.mapInArrow(tidy(inside), schema), run_folder(docs.sparkSession, "simhash"), "rows")
    # two rows per partition: the only window without a key runs over their numbers
    first = written.where("edge = 'first'")
    by_part = Window.orderBy("part")
    follows = first.select("part").withColumn("next_part", F.coalesce(
        F.lead("part").over(by_part), F.min("part").over(by_part.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = first.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("own").alias("next_own"))
    lasts = written.where("edge = 'last'").select("doc_id", "part", "text", "own")
    ends = lasts.join(follows, "part").join(heads, "next_part").select("doc_id", "text", "own", "next_text", "next_own")
    done = written.where("edge is null").unionByName(ends.mapInArrow(across, schema))
    every = written.where("edge is null or edge = 'last'").select(F.col("own").alias("fingerprint"))
    return done.drop("part", "edge", "text"), every


def edit_likeness(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Fingerprints as hexadecimal digits and their likeness, 1 less the share of bits that differ; and ``near``, the number
    of other fingerprints among all documents that differ in at most ``radius`` bits."""
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    like = lambda a, b: 1 - distance(F.col(a), F.col(b)) / 64
    rows, every = with_edited(docs)
    found = write_out(count_within(every, radius), run_folder(docs.sparkSession, "simhash"), "near")
    return rows.join(found.withColumnRenamed("fingerprint", "own"), "own", "left").select(
        "doc_id", "n_chars", "edited_sha256", digits("own").alias("fingerprint"),
        digits("edited").alias("edited_fingerprint"), like("own", "edited").alias("near_edited"),
        like("own", "following").alias("near_next"), F.coalesce("near", F.lit(0)).alias("near"))
