"""Prefix trie of conversations by fixed-length block hashing.

A turn is a 128-bit hash of role and text. A conversation is cut into blocks of ``BLOCK`` turns; a block's digest
is the exclusive or of its turns' hashes mixed with their places, and the digest of a prefix is the exclusive or
of its blocks. Conversations are grouped by successive block digests first. Where all that enter a block agree on
it, its turns are nodes as they stand, taken from one of them; only where siblings diverge inside a block are its
turn boundaries refined, and there by one representative per distinct block.

Numbers of a subtree need no walk over levels. Every node is owned by its smallest member; the nodes a conversation
owns are the last ones of its path. So a conversation that owns nodes carries their costs as running sums from the
end of its path, and sums per node over the conversations that pass it are sums over the subtree.

Skew: turns are numbered after a range exchange, so a long conversation spreads over tasks; a block is a bounded
row. Counts per node are combined before the exchange. Where a node has very many children they meet it by a
broadcast of at most ``HOT`` such nodes. The ids that end at a node are joined to pieces of text in range order, and
a node's pieces stream through one digest, since a SHA-256 can't be split.

Defined cases: rows without conv_id take no part; a null role or text is empty; turns are ordered by number (null
first), then role, then text, so rows of equal number have an order and repeated rows are turns of their own; an
empty table has no node, not even a root; further columns are ignored. Two different prefixes fall together with
probability n^2 / 2^129 for n prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.llm.common import tasks_of
from vitrine.shared import run_folder, write_out

BLOCK = 4
HOT = 1_000
IDS_PER_PIECE = 1_000
WORD = r"[^\x20\x09-\x0D]+"
_NODE = ["depth", "q1", "q2"]


def numbered(conversations: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Turns with a number that ascends in order, and per conversation and task where its numbers begin.

    Turns: conv_id, part, number, a, b (hash), words. Parts: conv_id, part, start, n; a turn's place in its
    conversation is number - start.
    """
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # a prefix of the role keeps the order and the borders small
    dealt = rows.repartitionByRange(tasks_of(rows.sparkSession), "conv_id", "turn", F.substring("role", 1, 64))
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    turns = write_out(ordered.select(
        "conv_id", F.monotonically_increasing_id().alias("number"),
        F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), folder, "turns").withColumn(
        "part", F.shiftright("number", 33))
    counted = turns.groupBy("conv_id", "part").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.select("conv_id", "part", "n", (
        F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("start"))
    return turns, write_out(parts, folder, "parts")


def with_shared_heads(turns: DataFrame, parts: DataFrame, folder: str, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that those of a family share their first turns.

    Conversation c takes the first h turns of conversation c - c % ``family`` for its own first h, with
    h = crc32(c) % ``most``. Gives conversations (conv_id, n) and turns (conv_id, place, a, b, words).
    """
    place = F.col("number") - F.col("start")
    roots = turns.where(F.col("conv_id") % family == 0).join(parts.where(F.col("conv_id") % family == 0), ["conv_id", "part"])
    heads = roots.withColumn("place", place).where(F.col("place") < most - 1).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "a", "b", "words"))).alias("head"))
    own = parts.groupBy("conv_id").agg(F.sum("n").alias("own")).withColumn(
        "h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")).withColumn(
        "root", F.col("conv_id") - F.col("conv_id") % family)
    joined = own.join(heads.withColumnRenamed("conv_id", "root"), "root", "left")
    none = F.array().cast("array<struct<place:bigint,a:bigint,b:bigint,words:bigint>>")
    taken = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    convs = write_out(joined.select("conv_id", "own", "h", taken.alias("head")).withColumn("got", F.size("head")).withColumn(
        "n", F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), folder, "conversations")
    shifted = parts.join(convs.select("conv_id", "h", "got"), "conv_id").select("conv_id", "part", "start", "h", "got")
    kept = turns.join(shifted, ["conv_id", "part"]).withColumn("place", place).where(F.col("place") >= F.col("h")).select(
        "conv_id", (F.col("place") - F.col("h") + F.col("got")).alias("place"), "a", "b", "words")
    heads = convs.select("conv_id", F.inline("head")).select("conv_id", "place", "a", "b", "words")
    return convs.select("conv_id", "n"), kept.union(heads)


def _digest(turns: Column, part: str) -> Column:
    """Exclusive or of the hashes of some turns and their places."""
    return F.aggregate(turns, F.lit(0).cast("long"), lambda s, t: s.bitwiseXOR(F.xxhash64(t["place"], t[part])))


def blocks(turns: DataFrame, size: int) -> DataFrame:
    """A row per block: its turns and the digests of the prefixes before and after it."""
    packed = turns.groupBy("conv_id", F.floor(F.col("place") / size).alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("place", "a", "b", "words"))).alias("turns"))
    own = packed.withColumn("x1", _digest(F.col("turns"), "a")).withColumn("x2", _digest(F.col("turns"), "b"))
    path = Window.partitionBy("conv_id").orderBy("k")
    before = lambda x: F.coalesce(
        F.bit_xor(x).over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return own.select(
        "conv_id", "k", "turns", F.size("turns").alias("m"), before("x1").alias("before1"), before("x2").alias("before2"),
        "x1", "x2", F.lead("k").over(path).isNull().alias("last")).withColumns({
            "after1": F.col("before1").bitwiseXOR(F.col("x1")), "after2": F.col("before2").bitwiseXOR(F.col("x2"))}).drop("x1", "x2")


def _prefix(i: Column, part: str) -> Column:
    """Digest of the prefix that ends with turn ``i`` of a block, 0 for the one before it."""
    name = {"a": "before1", "b": "before2"}[part]
    return F.when(i == 0, F.col(name)).otherwise(
        F.col(name).bitwiseXOR(_digest(F.slice("turns", F.lit(1), F.greatest(i, F.lit(1))), part)))


def join_by_fanout(many: DataFrame, one: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with ``one`` (unique on ``on``; ``fanout``: how many rows of ``many`` meet it).

    At most ``HOT`` rows of ``one`` have more than their share of all rows; these are broadcast, so that theirs
    need not meet in one task.
    """
    total = one.agg(F.sum("fanout")).first()[0] or 0
    limit = max(1, -(-total // HOT))
    hot = F.broadcast(one.where(F.col("fanout") > limit))
    few = one.where(F.col("fanout") <= limit)
    return many.join(hot, on).unionByName(many.join(hot.select(*on), on, "left_anti").join(few, on))


def _turn_nodes(given: DataFrame, size: int) -> DataFrame:
    """The nodes along the blocks of ``given``."""
    at = F.transform(F.sequence(F.lit(1), F.col("m")), lambda i: F.struct(
        (F.col("k") * size + i).cast("long").alias("depth"), _prefix(i, "a").alias("q1"), _prefix(i, "b").alias("q2"),
        _prefix(i - 1, "a").alias("p1"), _prefix(i - 1, "b").alias("p2"), F.get("turns", i - 1)["words"].alias("words")))
    return given.select("n", "least", F.inline(at))


def nodes(convs: DataFrame, chained: DataFrame, folder: str, size: int) -> DataFrame:
    """depth, q1, q2 (prefix), p1, p2 (prefix of the parent), n_convs, conv_id (smallest member), words."""
    entry = ["k", "before1", "before2"]
    groups = write_out(chained.groupBy(*entry, "after1", "after2", "m").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("turns").alias("turns")), folder, "groups")
    siblings = write_out(groups.groupBy(*entry).agg(F.count("*").alias("fanout")), folder, "siblings")
    met = join_by_fanout(groups, siblings, entry)
    columns = [*_NODE, "p1", "p2", "n_convs", "conv_id", "words"]
    agreed = _turn_nodes(met.where("fanout = 1"), size).withColumnsRenamed({"n": "n_convs", "least": "conv_id"})
    refined = _turn_nodes(met.where("fanout > 1"), size).groupBy(*_NODE).agg(
        F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.first("p1").alias("p1"),
        F.first("p2").alias("p2"), F.first("words").alias("words"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("q1"), zero.alias("q2"), zero.alias("p1"), zero.alias("p2"), "n_convs", "conv_id",
        zero.alias("words"))
    found = root.select(*columns).union(agreed.select(*columns)).union(refined.select(*columns))
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2")).agg(
        F.count("*").alias("n_children"))
    return write_out(write_out(found, folder, "nodes").join(children, _NODE, "left").fillna(0, ["n_children"]), folder, "tree")


def subtree_sums(chained: DataFrame, tree: DataFrame, size: int) -> DataFrame:
    """Per node: saved_tokens and n_leaves of its subtree."""
    cost = ((F.col("n_convs") - 1) * F.col("words")).alias("cost")
    owned = tree.where("depth > 0").groupBy("conv_id", F.floor((F.col("depth") - 1) / size).alias("k")).agg(
        F.map_from_entries(F.collect_list(F.struct("depth", cost))).alias("costs"), F.sum(cost).alias("block_cost"),
        F.count_if(F.col("n_children") == 0).alias("leaf"))
    path = Window.partitionBy("conv_id")
    later = F.sum("block_cost").over(path.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1))
    walked = chained.join(owned, ["conv_id", "k"], "left").withColumns({
        "later": F.coalesce(later, F.lit(0)), "leaves": F.sum("leaf").over(path)}).where("leaves is not null")

    def saved(i: Column) -> Column:
        rest = F.transform(F.sequence(F.greatest(i, F.lit(1)), F.col("m")), lambda j: F.coalesce(
            F.try_element_at("costs", (F.col("k") * size + j).cast("long")), F.lit(0).cast("long")))
        return F.col("later") + F.aggregate(rest, F.lit(0).cast("long"), lambda s, x: s + x)

    # a path begins at the root, so the first block gives one row more
    passed = F.transform(F.sequence(F.when(F.col("k") == 0, 0).otherwise(1), F.col("m")), lambda i: F.struct(
        (F.col("k") * size + i).cast("long").alias("depth"), _prefix(i, "a").alias("q1"), _prefix(i, "b").alias("q2"),
        saved(i).alias("saved")))
    return walked.select("leaves", F.inline(passed)).groupBy(*_NODE).agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))


def end_digests(ends: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the ids of the conversations that end there, ascending, joined by commas."""
    key = "depth long, q1 long, q2 long"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_NODE, "conv_id")]
            out = []
            for node, rows in groupby(zip(*columns), key=lambda r: r[:3]):
                ids = [r[3] for r in rows]
                out += [(*node, ids[i], ",".join(map(str, ids[i:i + IDS_PER_PIECE]))) for i in range(0, len(ids), IDS_PER_PIECE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])] if out else
                [pa.array([], t) for t in [pa.int64()] * 4 + [pa.string()]], names=[*_NODE, "least", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, None
        for batch in batches:
            done = []
            for *own, ids in zip(*[batch.column(c).to_pylist() for c in (*_NODE, "ids")]):
                if own != node:
                    if held is not None:
                        done.append((*node, held.hexdigest()))
                    node, held = own, hashlib.sha256(ids.encode())
                else:
                    held.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*_NODE, "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, held.hexdigest())], names=[*_NODE, "ends_sha256"])

    tasks = tasks_of(ends.sparkSession)
    ordered = ends.repartitionByRange(tasks, *_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    joined = ordered.mapInArrow(pieces, f"{key}, least long, ids string")
    return joined.repartition(tasks, *_NODE).sortWithinPartitions(*_NODE, "least").mapInArrow(
        digest, f"{key}, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """All nodes of the trie of ``turns`` (conv_id, place from 0, a, b: hash, words); ``convs``: conv_id, n (turns).

    Gives conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    folder = run_folder(convs.sparkSession, "trie")
    chained = write_out(blocks(turns, size), folder, "blocks")
    tree = nodes(convs, chained, folder, size)
    zero = F.lit(0).cast("long")
    ends = chained.where("last").select((F.col("k") * size + F.col("m")).cast("long").alias("depth"), F.col("after1").alias("q1"),
                                        F.col("after2").alias("q2"), "conv_id")
    ends = ends.union(convs.where("n = 0").select(zero, zero, zero, "conv_id"))
    parents = tree.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("fanout"))
    below = join_by_fanout(tree.where("depth > 0"), parents, ["depth", "p1", "p2"]).drop("fanout")
    top = tree.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    whole = below.unionByName(top).join(subtree_sums(chained, tree, size), _NODE, "left").join(end_digests(ends), _NODE, "left")
    alone = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", alone).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_nodes(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """The trie of conversations as they stand."""
    turns, parts = numbered(conversations, run_folder(conversations.sparkSession, "trie-turns"))
    placed = turns.join(parts.select("conv_id", "part", "start"), ["conv_id", "part"])
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    return trie(convs, placed.select("conv_id", (F.col("number") - F.col("start")).alias("place"), "a", "b", "words"), size)


def family_nodes(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """The trie of conversations rebuilt with shared heads."""
    folder = run_folder(conversations.sparkSession, "trie-turns")
    convs, turns = with_shared_heads(*numbered(conversations, folder), folder)
    return trie(convs, turns, size)


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"""
FAMILY_SQL = rf"""WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  cut AS (SELECT *, {_CRC} % 4 AS h FROM own),
  rebuilt AS (SELECT a.conv_id, list_concat(CASE WHEN b.s IS NULL THEN [] ELSE b.s[1:a.h] END, a.s[a.h + 1:]) AS s
    FROM cut a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
  prefixes AS (SELECT conv_id, d, s[1:d] AS p, len(s) = d AS last FROM rebuilt, unnest(range(0, len(s) + 1)) x(d)),
  node AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) END AS cost
    FROM prefixes GROUP BY d, p),
  kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
  tree AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, p)),
  sums AS (SELECT e AS d, p[1:e] AS p, sum(cost) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
    FROM (SELECT p, cost, n_children, unnest(range(0, d + 1)) AS e FROM tree) GROUP BY ALL)
  SELECT t.conv_id, t.d AS depth, up.conv_id AS parent_conv_id, t.n AS n_convs, t.n_children, sums.n_leaves,
    CAST(sums.saved AS BIGINT) AS saved_tokens, t.ends AS ends_sha256
  FROM tree t JOIN sums ON sums.d = t.d AND sums.p = t.p LEFT JOIN node up ON up.d = t.d - 1 AND up.p = t.p[1:t.d - 1]"""
