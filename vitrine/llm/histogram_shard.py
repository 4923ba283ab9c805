"""Sharding by histogram sort, in DataFrame operations only.

Rows have a sort key: hash of the text, then the id, as hexadecimal digits; equal texts thus lie side by side. Splitters are to divide the bytes evenly. Each round counts the exact
bytes below candidate boundaries (the prefixes of one more step of digits, only inside the bins that still hold an
unsettled splitter) over all partitions, and settles the splitters that come within the tolerance; few short rows
reach the driver. A bin that can't be divided is given to the nearer side. Then the documents move once.

A group of equal texts smaller than a mean shard is never divided: no probe looks beyond the text's hash while other
texts share its bin, and a splitter that falls into such a group goes to the nearer side, at most half the group
away. Only a group of a mean shard or more is divided by id (repeated rows of one id stay together).

Within a shard, a second hash deals rows into parts of bounded bytes, so that places in a shard are numbered
by many tasks: rows before the part plus the place in the part.

Defined cases: a null or empty text counts only the ``row_bytes``; null identifiers sort first; repeated rows are
rows of their own; with fewer rows than shards some shards stay empty; an empty table gives an empty result.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.llm.common import tasks_of
from vitrine.shared import run_folder, write_out

FIRST_DIGITS, MORE_DIGITS, TEXT_DIGITS = 3, 2, 16
ROW_BYTES = 16
PART_BYTES, LEAST_PARTS = 256 << 20, 8


def size_of(text: Column, row_bytes: int = ROW_BYTES) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + row_bytes


def sort_key(text: Column, doc_id: Column) -> Column:
    digits = lambda number: F.lpad(F.hex(number), 16, "0")
    return F.concat(digits(F.xxhash64(F.coalesce(text, F.lit("")))), F.coalesce(digits(doc_id.cast("long")), F.lit("")))


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.002) -> list[str]:
    """Boundaries of ``key`` that divide ``size`` into ``shards`` nearly equal parts: a key belongs behind all the
    boundaries that aren't greater than it. The tolerance is a share of the mean shard."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    found: dict[int, str] = {}
    # prefix of an open bin -> bytes below it, digits of the next probes, numbers of its splitters
    open_bins = {"": (0, FIRST_DIGITS, list(range(1, shards)))} if total else {}
    while open_bins:
        probe = F.lit(None).cast("string")
        for prefix, (_, digits, _) in open_bins.items():
            probe = F.when(F.startswith("key", F.lit(prefix)), F.substring("key", 1, digits)).otherwise(probe)
        counted = keys.withColumn("probe", probe).where("probe is not null").groupBy("probe").agg(
            F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        bins = sorted((r["probe"], r["bytes"], r["low"], r["high"]) for r in counted)
        after: dict[str, tuple[int, int, list[int]]] = {}
        for prefix, (below, _, wanted) in open_bins.items():
            own = [b for b in bins if b[0].startswith(prefix)]
            for name, size, low, high in own:
                while wanted and wanted[0] * total / shards <= below + size:
                    k = wanted.pop(0)
                    goal = k * total / shards
                    short, over = goal - below, below + size - goal
                    one_text = low[:TEXT_DIGITS] == high[:TEXT_DIGITS]
                    if min(short, over) <= allowed or low == high or (one_text and size < total / shards):
                        found[k] = name if short < over else name + "G"  # G follows the digits
                    else:
                        digits = len(commonprefix([low, high])) + MORE_DIGITS
                        digits = digits if one_text else min(digits, TEXT_DIGITS)
                        after.setdefault(name, (below, digits, []))[2].append(k)
                below += size
            for k in wanted:
                found[k] = "G"
        open_bins = after
    return [found.get(k, "G") for k in range(1, shards)]


def shard_of(key: Column, boundaries: list[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(b) for b in boundaries]).cast("array<string>"), lambda b: b <= key))


def shard_documents(docs: DataFrame, shards: int = 40, tolerance: float = 0.002) -> DataFrame:
    """The written shards: ``doc`` (all columns of a document), key, size, shard, part."""
    folder = run_folder(docs.sparkSession, "shards")
    row = docs.select(F.struct("*").alias("doc")).select(
        "doc", sort_key(F.col("doc.text"), F.col("doc.doc_id")).alias("key"), size_of(F.col("doc.text")).alias("size"))
    keys = write_out(row.select("key", "size"), folder, "keys")
    boundaries = splitters(keys, shards, tolerance)
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(LEAST_PARTS, -(-total // shards // PART_BYTES))
    placed = row.withColumn("shard", shard_of(F.col("key"), boundaries)).withColumn(
        "part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    return write_out(placed.repartition(tasks_of(docs.sparkSession), "shard", "part"), folder, "rows")


def with_slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without gaps: ``slot``."""
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key")) - 1
    return placed.withColumn("place", place).join(offsets, ["shard", "part"]).withColumn(
        "slot", F.col("offset") + F.col("place")).drop("offset", "place")


def digests(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = shard_documents(docs, shards).select(
        "doc.doc_id", "size", F.crc32(F.coalesce("doc.text", F.lit(""))).alias("text_crc32"), "key", "shard", "part")
    return with_slots(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                   F.lit(None).cast("int").alias("grown_shard"))
