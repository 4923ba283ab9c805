"""Keep-first, caps, and unions whose later parts are only a fallback."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def cap_per_group(rows: DataFrame, group: Sequence[str], order: Sequence, limit: int) -> DataFrame:
    """W5, L7. The first ``limit`` rows of every group.

    Spark prunes each map task's groups to ``limit`` rows before the shuffle (WindowGroupLimit), so a
    group that holds a third of the data costs no more than the others.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= limit).drop("_n")


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """W1, W2. The first row per key in arrival order."""
    return cap_per_group(rows, keys, order, 1)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """O1, O4."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def until_enough(rows: DataFrame, group: Sequence[str], stage: Sequence[str],
                 limit: Column | int, most: int) -> DataFrame:
    """O2. A stage (page, tier) contributes only while the earlier ones gave fewer than ``limit`` rows.

    ``rank() - 1`` over the stages is the number of rows in earlier stages, so one window does it and
    its group limit prunes before the shuffle. ``limit`` may depend on the stage columns but must not
    grow from stage to stage; ``most`` is its largest value.
    """
    window = Window.partitionBy(*group).orderBy(*stage)
    ranked = rows.withColumn("_rank", F.rank().over(window)).filter(F.col("_rank") <= most)
    return ranked.filter(F.col("_rank") <= limit).drop("_rank")


def first_filled_tier(tiers: Sequence[DataFrame], page: Sequence[str]) -> DataFrame:
    """O2. Per page the rows of the first tier that has any."""
    return until_enough(union_all(tiers), page, ["tier"], limit=1, most=1)
