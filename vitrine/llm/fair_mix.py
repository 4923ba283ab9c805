"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source are shuffled by a seeded hash. A document's virtual finish time is its source's words up to and
with it, divided by the source's target; sources thus advance side by side, each as fast as its target. A source whose
target exceeds its size goes round again, at most ``repeats`` times. All are range-sorted by virtual finish time;
sums per range and the offsets that follow from them give the running total, and the mix ends where that reaches
the budget, the sum of all targets. So that a long document can't push its source far off, one of more words than a
``QUANTA``-th of the target is queued in quanta of that many words, as packets are; a source thus ends within a quantum of its target.

A source may hold most rows, so no window has the source alone as its key: the hash also deals a source's
documents into buckets that follow its own count, whose sums are added up first; running sums then go over one bucket
of one source. Bucket sums are the only thing that is scanned per source. A document that starts after its source's target
can't be reached before the budget ends, and isn't sorted.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating. They share the budget by weight; what a
source can't take (``repeats`` times its size) is shared again among the others by weight, until none is above.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is a source of its own; repeated
rows are documents of their own; sources without words have target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.llm.common import tasks_of
from vitrine.shared import run_folder, write_out

WORD = r"[^\x20\x09-\x0D]+"
#: Documents per bucket that the number of buckets of a source aims at.
BUCKET_ROWS = 1_000
QUANTA = 1_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source``, ``source_size`` to the same with ``target``. The number of sources is small; sums are windows
    over them.

    Sources reach their limit in the order of limit / weight. Let the first k be at their limit; the others
    share the rest by weight. k is right if the next source stays within its limit. So one sort and running sums
    replace the rounds of sharing again.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(place) - 1) % len(weights) + 1)
    rows = sources.withColumn("weight", weight.cast("double")).withColumn(
        "most", F.lit(repeats) * F.col("source_size"))
    whole = Window.partitionBy(F.lit(0))
    by_need = whole.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*", F.sum("source_size").over(whole).alias("budget"),
        F.coalesce(F.sum("most").over(before), F.lit(0)).alias("full"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
        F.row_number().over(by_need).alias("k"))
    rows = rows.withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    stays = F.col("level") * F.col("weight") <= F.col("most")
    rows = rows.withColumn("first_open", F.min(F.when(stays, F.col("k"))).over(whole)).withColumn(
        "share", F.max(F.when(F.col("k") == F.col("first_open"), F.col("level"))).over(whole))
    return rows.select("source", "source_size", F.when(
        F.col("k") < F.coalesce("first_open", F.lit(1 << 30)), F.col("most").cast("double"))
        .otherwise(F.col("share") * F.col("weight")).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def queued(docs: DataFrame, repeats: int = 3, seed: int = 0) -> DataFrame:
    """A row per quantum of each pass of a document: its columns and source_size, target, round (0, 1, ...), quantum,
    words, finish (virtual time). ``docs`` has doc_id, source, size, ``salt`` (what the shuffle hashes) and ``row``, which tells
    rows apart.
    """
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goals = targets(sums.drop("rows"), repeats).withColumnRenamed("source", "g")
    goals = goals.join(sums.select(F.col("source").alias("of"), F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets")), _same("of", "g")).drop("of")
    mixed = docs.withColumn("turn", F.xxhash64(F.lit(seed), "salt")).join(goals, _same("source", "g")).drop("g").withColumn(
        "bucket", F.pmod(F.shiftright("turn", 20), F.col("buckets"))).drop("buckets")
    per_bucket = mixed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size", "row").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = mixed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, _same("source", "s") & (F.col("bucket") == F.col("b"))).drop("s", "b")
    rounds = F.sequence(F.lit(0), F.lit(repeats - 1))
    passes = placed.where("size > 0").withColumn("round", F.explode(rounds)).withColumn(
        "begin", F.col("round") * F.col("source_size") + F.col("offset") + F.col("inside")).where("begin < target")
    most = F.greatest(F.lit(1), F.floor(F.col("target") / QUANTA)).cast("long")
    reach = F.least(F.col("size").cast("double"), F.col("target") - F.col("begin"))
    quanta = passes.withColumn("most", most).withColumn(
        "quantum", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(reach / F.col("most"))).cast("long") - 1)))
    before = F.col("quantum") * F.col("most")
    return quanta.withColumn("words", F.least(F.col("most"), F.col("size") - before)).withColumn(
        "finish", (F.col("begin") + before + F.col("words")) / F.col("target")).drop(
        "salt", "bucket", "inside", "offset", "begin", "most")


ORDER = ("finish", "source", "round", "turn", "doc_id", "row", "quantum")


def mix_order(docs: DataFrame, folder: str, repeats: int = 3, seed: int = 0, budget_share: float = 1.0) -> DataFrame:
    """The mix in its order: the queue range-sorted by virtual finish time and cut at the budget. Adds ``served`` (words).

    ``budget_share``: how much of the sum of targets the mix takes.
    """
    ranged = queued(docs, repeats, seed).repartitionByRange(tasks_of(docs.sparkSession), *ORDER).sortWithinPartitions(*ORDER)
    line = write_out(ranged.withColumn("part", F.spark_partition_id()), folder, "queue")
    budget = int((docs.agg(F.sum("size")).first()[0] or 0) * budget_share + 1e-6)
    sums = line.groupBy("part").agg(F.sum("words").alias("part_words"))
    # one row per range: the only window without a key runs over these
    ahead = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("part_words").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    met = line.join(ahead, F.col("part") == F.col("p")).where(F.col("ahead") < budget)
    left = F.lit(budget) - F.col("ahead") - F.coalesce(F.sum("words").over(within), F.lit(0))
    return met.withColumn("served", F.least(F.col("words"), left)).where("served > 0").drop("p", "ahead", "words", "part")


def sized(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, source and size of every document, written once: the text is read a single time."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       F.xxhash64("doc_id", "text").alias("salt"), F.monotonically_increasing_id().alias("row"))
    return write_out(rows, folder, "sizes")


def taken(docs: DataFrame, repeats: int = 3, seed: int = 0) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (its words in the mix), first_finish."""
    folder = run_folder(docs.sparkSession, "mix")
    rows = sized(docs, folder)
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), repeats)
    served = mix_order(rows, folder, repeats, seed).groupBy("row").agg(
        F.sum("served").alias("taken"), F.min("finish").alias("first_finish"))
    goals = goals.withColumnRenamed("source", "g")
    return rows.join(served, "row", "left").join(goals, _same("source", "g")).select(
        "doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
        F.coalesce("taken", F.lit(0)).alias("taken"), "first_finish")


def mixed_documents(docs: DataFrame, repeats: int = 3, seed: int = 0) -> DataFrame:
    """The documents of the mix with their own columns, a row per pass, in no order. A pass counts if the mix
    takes at least half of its words."""
    folder = run_folder(docs.sparkSession, "mix")
    keyed = write_out(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), folder, "docs")
    sizes = write_out(keyed.select(
        "doc.doc_id", "doc.source", word_count(F.col("doc.text")).alias("size"),
        F.xxhash64("doc.doc_id", "doc.text").alias("salt"), "row"), folder, "sizes")
    passes = mix_order(sizes, folder, repeats, seed).groupBy("row", "round").agg(
        F.sum("served").alias("served"), F.first("size").alias("size"))
    times = passes.where("2 * served >= size").groupBy("row").agg(F.count("*").alias("times"))
    kept = keyed.join(times, "row").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return kept.select("doc.*")
