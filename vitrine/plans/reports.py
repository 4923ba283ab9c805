"""The reports over history and run log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vitrine import fixed_values as fv
from vitrine.functions.text import amount_or_na
from vitrine.operators.history import source_stats
from vitrine.operators.tiers import cap_per_group


def health(errors: Column, runs: Column) -> Column:
    """P34."""
    return F.when(runs.isNull(), "no data").when(errors == 0, "ok").when(errors < runs, "warn").otherwise("fail")


def source_health(enabled: DataFrame, runs: DataFrame, now: Column, hours: int = fv.STATS_HOURS) -> DataFrame:
    """J9. Every enabled source with its recent statistics, marked when there are none."""
    stats = source_stats(runs, now, hours)
    return enabled.select("source").join(stats, "source", "left").withColumn(
        "health", health(F.col("total_errors"), F.col("runs")))


def disabled_sources(available: DataFrame, enabled: DataFrame) -> DataFrame:
    """J10, O3, L6."""
    return available.select("source").join(enabled.select("source"), "source", "left_anti").orderBy("source")


def source_states(available: DataFrame, enabled: DataFrame) -> DataFrame:
    """J11. Every source, active or not."""
    on = enabled.select("source").distinct().withColumn("_on", F.lit(True))
    return available.select("source").join(on, "source", "left").select(
        "source", F.coalesce("_on", F.lit(False)).alias("active")).orderBy("source")


def recent_offers(sent: DataFrame, order: Sequence, limit: int = 10) -> DataFrame:
    """L3, P38. The newest published offers, ready to print."""
    return sent.orderBy(*order).limit(limit).select(
        "link", "store", F.left("title", F.lit(50)).alias("title"), amount_or_na(F.col("price")).alias("price"))


def source_samples(offers: DataFrame, order: Sequence, limit: int = 5) -> DataFrame:
    """L7, P38. The first offers of every source, ready to print."""
    marks = F.concat_ws(
        " | ", amount_or_na(F.col("price")), F.nullif(F.col("coupon_code"), F.lit("")),
        F.when(F.col("image_url") != "", "image"))
    return cap_per_group(offers, ["store"], order, limit).select(
        "store", F.left("title", F.lit(60)).alias("title"), marks.alias("details"))


def blocked_words(permanent: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """O5. Permanent and added words without the removed ones, each once."""
    word = F.lower(F.trim("keyword")).alias("keyword")
    return permanent.select(word).union(added.select(word)).distinct().join(
        removed.select(word), "keyword", "left_anti")
