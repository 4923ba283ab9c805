"""SK1-SK6, A1-A3, W7: published offers, price history and source runs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vitrine import fixed_values as fv
from vitrine.functions.pricing import calculated_discount, money
from vitrine.operators.tiers import keep_first
from vitrine.schemas import PRICE_HISTORY, SENT_OFFERS
from vitrine.shared import run_folder, write_out


def as_sent(offers: DataFrame, sent_at: Column, batch_id: Column) -> DataFrame:
    """SK4. Offer to published row; the calculated discount is recorded."""
    discount = calculated_discount(F.col("price"), F.col("original_price"), F.col("discount_pct"))
    return offers.select(
        "link", "title", money(F.col("price")).alias("price"),
        money(F.col("original_price")).alias("original_price"), discount.alias("discount_pct"),
        "store", F.coalesce("category", F.lit("")).alias("category"),
        sent_at.cast("timestamp").alias("sent_at"), F.col("score").cast("double").alias("score"),
        batch_id.cast("long").alias("batch_id"), F.to_date(sent_at).alias("sent_date"),
    )


def insert_if_absent(new: DataFrame, sent: DataFrame, order: Sequence) -> DataFrame:
    """SK1. The rows to append: first per link, link not published before."""
    return keep_first(new, ["link"], order).join(sent.select("link"), "link", "left_anti").select(*new.columns)


def price_points(inserted: DataFrame, observe_all: DataFrame | None = None) -> DataFrame:
    """SK2. Price observations of inserted offers; with ``observe_all`` of every offer given there."""
    rows = inserted if observe_all is None else observe_all
    return rows.filter(F.col("price").isNotNull()).select(
        "link", "price", F.col("sent_at").alias("recorded_at"), "batch_id")


def run_rows(runs: DataFrame) -> DataFrame:
    """SK3, A11. Run log rows with the run's status.

    Expects source, run_at, duration_secs, items_found, items_sent, failure (null, ``timeout``, other
    text) and errors. A run that failed from outside has no duration and counts one error.
    """
    failed = F.col("failure").isNotNull()
    return runs.select(
        "source", "run_at",
        F.when(failed, 0.0).otherwise(F.col("duration_secs")).alias("duration_secs"),
        F.when(failed, 0).otherwise(F.col("items_found")).cast("long").alias("items_found"),
        F.col("items_sent").cast("long").alias("items_sent"),
        F.when(failed, 1).otherwise(F.col("errors")).cast("long").alias("errors"),
        F.when(F.col("failure") == "timeout", "timeout").when(failed, "exception")
        .when(F.col("errors") > 0, "error").otherwise("ok").alias("status"),
    )


def append_batch(rows: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Write a batch's partitions. Writing the same batch again replaces what it wrote before."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(location):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_sent(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, SENT_OFFERS)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, PRICE_HISTORY)


def kept_since(sent: DataFrame, now: Column, days: int = fv.RETENTION_DAYS) -> DataFrame:
    """SK6. Rows young enough to stay; 0 days keeps only rows from now on."""
    return sent.filter(F.col("sent_at") >= now - F.make_dt_interval(days=F.lit(days)))


def purge_before(spark: SparkSession, path: str, cutoff: datetime) -> None:
    """SK6 on the stored table: rewrite the day of the cutoff, then drop what lies wholly before it.

    The kept rows stand in the table before anything is deleted; a purge that broke off is simply run again.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    day = cutoff.date().isoformat()
    boundary = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/sent_date={day}")
    gone = [s.getPath() for s in files.listStatus(root)
            if s.getPath().getName().startswith("sent_date=") and s.getPath().getName() < f"sent_date={day}"]
    if files.exists(boundary):
        on_day = read_sent(spark, path).filter(F.col("sent_date") == F.lit(day).cast("date"))
        kept = write_out(on_day.filter(F.col("sent_at") >= F.lit(cutoff)), run_folder(spark, "purge"), "kept")
        append_batch(kept, path, ["sent_date", "batch_id"])
        batches = {f"batch_id={r[0]}" for r in kept.select("batch_id").distinct().collect()}
        gone += [s.getPath() for s in files.listStatus(boundary)
                 if s.getPath().getName().startswith("batch_id=") and s.getPath().getName() not in batches]
    for partition in gone:
        files.delete(partition, True)


# --- reads -------------------------------------------------------------------
def source_stats(runs: DataFrame, now: Column, hours: int = fv.STATS_HOURS) -> DataFrame:
    """A1, F10. Per source over the last hours."""
    return (
        runs.filter(F.col("run_at") > now - F.make_dt_interval(hours=F.lit(hours)))
        .groupBy("source").agg(
            F.count("*").alias("runs"), F.sum("items_found").alias("total_found"),
            F.sum("items_sent").alias("total_sent"), F.sum("errors").alias("total_errors"),
            F.avg("duration_secs").alias("avg_duration"))
    )


def sent_count(sent: DataFrame) -> DataFrame:
    """A2."""
    return sent.agg(F.count("*").alias("promos"))


def lowest_price(prices: DataFrame) -> DataFrame:
    """A3. Per link."""
    return prices.groupBy("link").agg(F.min("price").alias("lowest_price"))


def prices_of(prices: DataFrame, links: DataFrame) -> DataFrame:
    """J12, L8. Price series of the given links; each link's rows lie together, ascending in time."""
    return prices.join(links.select("link"), "link", "left_semi").select(
        "link", "price", "recorded_at").repartition("link").sortWithinPartitions("link", "recorded_at")


def price_series(prices: DataFrame, order: Sequence = ("recorded_at",), parts: int | None = None) -> DataFrame:
    """W7. Every observation with the lowest price so far and the change to the one before.

    One link may hold a large part of all observations, so this is a prefix scan over ranges: observations are dealt out by
    link and order, as many ranges as shuffle partitions (or ``parts``), so that a hot link lies in many of them. Each
    range gives one row per link (lowest and last price), from which what earlier ranges hand on is known; then every range is
    worked off by itself. Rows without a link are one series; rows without a time come first in theirs.
    """
    spark = prices.sparkSession
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = prices.repartitionByRange(ranges, "link", *columns).withColumn("_part", F.spark_partition_id())
    cut = write_out(dealt, run_folder(spark, "series"), "ranges")
    last = F.max_by(F.struct("price"), F.struct(*columns))["price"]
    summary = cut.groupBy("link", "_part").agg(F.min("price").alias("_low"), last.alias("_last"))
    over = Window.partitionBy("link").orderBy("_part")
    carried = summary.select(
        F.col("link").alias("_link"), F.col("_part").alias("_of"),
        F.min("_low").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_low_before"),
        F.lag("_last").over(over).alias("_last_before"))
    met = cut.join(carried, F.col("link").eqNullSafe(F.col("_link")) & (F.col("_part") == F.col("_of")))
    inside = Window.partitionBy("link", "_part").orderBy(*columns)
    return (
        met
        .withColumn("lowest_so_far", F.least(
            F.min("price").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_low_before")))
        .withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn("previous_price", F.when(F.col("_first"), F.col("_last_before")).otherwise(F.lag("price").over(inside)))
        .withColumn("change", F.col("price") - F.col("previous_price"))
        .withColumn("at_lowest", F.col("price") == F.col("lowest_so_far"))
        .drop("_part", "_low_before", "_last_before", "_first", "_link", "_of")
    )
