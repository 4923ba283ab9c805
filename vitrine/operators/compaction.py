"""SK6, ST9: a day's many small batches become a few files of bounded size.

The rows of a day are written once more under a ``batch_id`` of the day's own (below zero), their number is compared with
the number read, and one row of the manifest swaps them for the batches. Batches that come later for the same day stand
beside it until the next merge. What has been replaced is deleted by ``drop_replaced``, later, when no reader can have it open.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.operators import commits
from vitrine.operators.history import read_sent
from vitrine.operators.link_filters import append_sent, partitions

ROWS_PER_FILE = 1_000_000
#: Merges of one day that its numbers leave room for.
ROOM = 1_000


def compact(spark: SparkSession, path: str, manifest: str, before: date | None = None) -> list[date]:
    """Merge all days (those before ``before``) of the table of published offers that lie in more than one batch.

    One job reads and writes all of them; their numbers, a row per day, reach the driver.
    """
    rows = commits.visible(read_sent(spark, path), manifest).filter("sent_date is not null")
    if before is not None:
        rows = rows.filter(F.col("sent_date") < F.lit(before))
    days = rows.groupBy("sent_date").agg(
        F.count("*").alias("n"), F.max("batch_id").alias("through"), F.countDistinct("batch_id").alias("batches"),
        F.min("batch_id").alias("least")).filter("batches > 1").collect()
    if not days:
        return []
    past = {r["day"]: r["through"] for r in commits.merged_days(spark, manifest).collect()}
    number = lambda r: min(r["least"], -(r["sent_date"].toordinal() * ROOM)) - 1
    plan = spark.createDataFrame([(r["sent_date"], number(r), -(-r["n"] // ROWS_PER_FILE)) for r in days],
                                 "sent_date date, merged long, files long")
    # a large day is dealt to several files
    dealt = rows.join(plan, "sent_date").withColumn("file", F.pmod(F.xxhash64("link", "sent_at"), F.col("files")))
    merged = dealt.withColumn("batch_id", F.col("merged")).repartition("sent_date", "file").select(*rows.columns)
    append_sent(merged, path)
    _check(spark, path, plan, {r["sent_date"]: r["n"] for r in days})
    commits.commit_days(spark, manifest, [
        (r["sent_date"], max(r["through"], past.get(r["sent_date"], r["through"])), number(r)) for r in days], path)
    return sorted(r["sent_date"] for r in days)


def _check(spark: SparkSession, path: str, plan: DataFrame, wanted: dict[date, int]) -> None:
    written = read_sent(spark, path).join(plan, ["sent_date"]).filter("batch_id = merged").groupBy("sent_date").count()
    found = {r["sent_date"]: r["count"] for r in written.collect()}
    if found != wanted:
        raise RuntimeError(f"merged days differ from their batches: {found} and {wanted}")


def drop_replaced(spark: SparkSession, path: str, manifest: str) -> int:
    """Delete the partitions that merged days have replaced, and their filters. Gives their number."""
    merged = {f"sent_date={r['day'].isoformat()}": (r["through"], r["merged"]) for r in commits.merged_days(spark, manifest).collect()}
    files, gone = None, 0
    for folder in (f"{path}_filters", path):
        for day, batch in partitions(spark, folder):
            number = int(batch.removeprefix("batch_id="))
            if day in merged and number <= merged[day][0] and number != merged[day][1]:
                place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{day}/{batch}")
                files = files or place.getFileSystem(spark._jsc.hadoopConfiguration())
                files.delete(place, True)
                gone += folder == path
    return gone
