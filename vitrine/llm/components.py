"""Connected groups of links by contraction, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.shared import write_out


def contract(links: DataFrame, folder: str, name: str) -> DataFrame:
    """``a``, ``b`` to ``key``, ``group``: every linked key with one key of its group.

    Each round points a key at the smallest key among itself and its neighbours, replaces keys by what they
    point at and drops what became a loop; at least every other key of a group goes, so rounds grow with the
    logarithm of the longest path. Every round's tables are written to the shared folder.
    """
    edges = write_out(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                      folder, f"{name}-edges")
    groups, turn = None, 0
    while True:
        both = edges.union(edges.select("b", "a"))
        points = write_out(both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("key"), F.least("a", "low").alias("next")), folder, f"{name}-points-{turn}")
        if groups is None:
            groups = points.select("key", F.col("next").alias("group"))
        else:
            step = points.select(F.col("key").alias("group"), "next")
            groups = write_out(groups.join(step, "group", "left").select(
                "key", F.coalesce("next", "group").alias("group")), folder, f"{name}-groups-{turn}")
        to_a = points.select(F.col("key").alias("a"), F.col("next").alias("na"))
        to_b = points.select(F.col("key").alias("b"), F.col("next").alias("nb"))
        edges = write_out(edges.join(to_a, "a").join(to_b, "b").where("na != nb").select(
            F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), folder, f"{name}-edges-{turn}")
        turn += 1
        if edges.isEmpty():
            return groups
