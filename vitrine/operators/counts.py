"""Funnels, rates and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.functions.text import rate_text
from vitrine.functions.urls import url_host
from vitrine.operators.quality import reason_code


def quality_funnel(gated: DataFrame) -> DataFrame:
    """A4. Of rows with ``reason``: processed, passed, filtered, pass rate."""
    return gated.agg(
        F.count("*").alias("total_processed"), F.count_if(F.col("reason").isNull()).alias("passed"),
        F.count_if(F.col("reason").isNotNull()).alias("filtered"),
    ).withColumn("pass_rate", rate_text(F.col("passed"), F.col("total_processed")))


def refusals(gated: DataFrame) -> DataFrame:
    """A10. Refused rows per reason code."""
    return gated.filter(F.col("reason").isNotNull()).groupBy(
        reason_code(F.col("reason")).alias("reason_code")).agg(F.count("*").alias("offers"))


def duplicate_funnel(checked: DataFrame) -> DataFrame:
    """A5. Of rows with ``verdict``: checked, unique, duplicates (also per layer), duplicate rate."""
    return checked.agg(
        F.count("*").alias("total_checked"),
        F.count_if(F.col("verdict") == "accepted").alias("unique"),
        F.count_if(F.col("verdict") != "accepted").alias("duplicates"),
        F.count_if(F.col("verdict") == "same_link").alias("same_link"),
        F.count_if(F.col("verdict") == "similar_title").alias("similar_title"),
    ).withColumn("duplicate_rate", rate_text(F.col("duplicates"), F.col("total_checked")))


def cycle_funnel(rows: DataFrame, batch: str, filtered: Column, unique: Column, sent: Column) -> DataFrame:
    """A6. Per batch: collected, filtered, unique, sent; the stages are flags on the collected rows."""
    return rows.groupBy(batch).agg(
        F.count("*").alias("collected"), F.count_if(filtered).alias("filtered"),
        F.count_if(filtered & unique).alias("unique"),
        F.count_if(filtered & unique & sent).alias("sent"))


def running_totals(per_batch: DataFrame, batch: str, columns: Sequence[str], block: int = 4096) -> DataFrame:
    """W6. Totals up to and with every batch.

    Batches (one row each) are summed within blocks and the blocks' own totals are carried over, so no
    task sees more than a block, or one row per block.
    """
    numbered = per_batch.withColumn("_block", F.floor(F.col(batch) / block))
    up_to = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = numbered.groupBy("_block").agg(*[F.sum(c).alias(c) for c in columns])
    carried = sums.select("_block", *[
        F.coalesce(F.sum(c).over(up_to), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy("_block").orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    # rows without a batch form a block of their own, before all others
    met = numbered.join(carried.withColumnRenamed("_block", "_of"), F.col("_block").eqNullSafe(F.col("_of")))
    return met.select(
        batch, *columns, *[(F.sum(c).over(inside) + F.col(f"_{c}")).alias(f"total_{c}") for c in columns])


def error_domains(requests: DataFrame, failed: Column, top: int = 5) -> DataFrame:
    """A8, L4. Hosts with the most failed requests; equal counts by name."""
    return (
        requests.filter(failed).groupBy(url_host(F.col("url")).alias("domain"))
        .agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), "domain").limit(top)
    )


def error_rate(requests: DataFrame, failed: Column) -> DataFrame:
    """A8."""
    return requests.agg(F.count("*").alias("total_requests"), F.count_if(failed).alias("total_errors")).withColumn(
        "error_rate", rate_text(F.col("total_errors"), F.greatest("total_requests", F.lit(1))))


def per_source(runs: DataFrame) -> DataFrame:
    """A9, A11. Per source: runs, items, errors and runs per status."""
    return runs.groupBy("source").agg(
        F.count("*").alias("runs"), F.sum("items_found").alias("total_items"),
        F.sum("errors").alias("total_errors"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_runs") for s in ("ok", "error", "exception", "timeout")])


def distinct_keys(rows: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """A12."""
    return rows.groupBy(*by).agg(F.countDistinct(key).alias("distinct_keys"))
