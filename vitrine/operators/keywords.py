"""The first keyword of a list of any length that occurs in a title.

A list is cut into ranges of its priority order, each of about ``RANGE_CHARS`` characters. A range becomes an
Aho-Corasick automaton, built once per Python worker, that finds all its keywords in one walk over a title; so the cost of a
title hardly depends on the number of keywords, and titles are neither shuffled nor joined. Earlier ranges have
priority, so a title that has its keyword is passed over by later ranges. After ``RANGES_AT_ONCE`` ranges the rows are
written and read again, which bounds what a worker holds, however long the list.

The driver handles one range at a time; its size is the bound of what is sent to every worker.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from vitrine.shared import run_folder, write_out

RANGE_CHARS, RANGES_AT_ONCE = 1_000_000, 3
LAST = (1 << 63) - 1
_HIT = "struct<keyword:string,weight:double,priority:bigint>"
#: Automata of this Python worker by the name of their range; a few at most are kept.
_built: dict[str, object] = {}


def _automaton(name: str, words: Broadcast):
    if name not in _built:
        import ahocorasick
        while len(_built) >= 2 * RANGES_AT_ONCE:
            _built.pop(next(iter(_built)))
        automaton = ahocorasick.Automaton()
        for place, (lowered, *_) in enumerate(words.value):
            automaton.add_word(lowered, place)
        automaton.make_automaton()
        _built[name] = automaton
    return _built[name]


def _range_hit(name: str, words: Broadcast, before: Column | None):
    """A column function: the hit of the ranges before, else the first keyword of this range in the title."""
    def first(title: str | None, automaton) -> tuple | None:
        place = None if title is None else min((p for _, p in automaton.iter(title)), default=None)
        return None if place is None else words.value[place][1:]

    def frame(hits: list) -> pd.DataFrame:
        return pd.DataFrame([h or (None, None, None) for h in hits], columns=["keyword", "weight", "priority"]).astype(
            {"weight": "float64", "priority": "Int64"})

    @F.pandas_udf(_HIT)
    def alone(title: pd.Series) -> pd.DataFrame:
        automaton = _automaton(name, words)
        return frame([first(t, automaton) for t in title])

    @F.pandas_udf(_HIT)
    def after(title: pd.Series, done: pd.Series) -> pd.DataFrame:
        automaton = _automaton(name, words)
        return frame([None if d else first(t, automaton) for t, d in zip(title, done)])

    return alone if before is None else lambda title: after(title, before["keyword"].isNotNull())


def _ranges(rules: DataFrame, folder: str, chars: int) -> tuple[DataFrame, int]:
    """The list without repeated keywords, in ranges numbered by priority."""
    column = lambda name, other, kind: (F.col(name) if name in rules.columns else F.lit(other)).cast(kind).alias(name)
    rows = rules.select(F.lower("keyword").alias("lowered"), "keyword", column("weight", None, "double"),
                        F.coalesce(column("priority", LAST, "long"), F.lit(LAST)).alias("priority")).filter(F.length("keyword") > 0)
    once = write_out(rows.groupBy("lowered").agg(F.min(F.struct("priority", "keyword", "weight")).alias("rule")).select(
        "lowered", "rule.keyword", "rule.weight", "rule.priority"), folder, "rules")
    total = once.agg(F.sum(F.length("lowered"))).first()[0] or 0
    order = ("priority", "lowered")
    count = -(-total // chars)
    ranged = once.repartitionByRange(max(1, count), *order).withColumn("part", F.spark_partition_id())
    return write_out(ranged, folder, "ranges"), count


def with_first_rule(rows: DataFrame, rules: DataFrame, lowered: str, into: str, chars: int = RANGE_CHARS) -> DataFrame:
    """Adds ``into``: keyword, weight and priority of the rule of smallest priority whose keyword occurs in ``lowered``.

    ``rules``: keyword and, where they matter, weight and priority (equal ones: by keyword). Keywords are compared in lower
    case; null and empty ones match nothing, nor does anything match a null title. Without a match the struct's fields are null.
    """
    spark = rows.sparkSession
    folder = run_folder(spark, "keywords")
    ranged, count = _ranges(rules, folder, chars)
    hit, held = None, 0
    if into in rows.columns:
        raise ValueError(f"there is a column {into} already")
    for part in range(count):
        listed = ranged.filter(F.col("part") == part).orderBy("priority", "lowered").select(
            "lowered", "keyword", "weight", "priority").collect()
        if not listed:
            continue
        if held == RANGES_AT_ONCE:
            rows, held = write_out(rows, folder, f"after-{part}"), 0
        words = spark.sparkContext.broadcast([tuple(r) for r in listed])
        before = None if hit is None else F.col(into)
        found = _range_hit(f"{folder}/{part}", words, before)(F.col(lowered))
        rows = rows.withColumn(into, found if hit is None else F.when(F.col(into)["keyword"].isNotNull(), F.col(into)).otherwise(found))
        hit, held = into, held + 1
    return rows if hit else rows.withColumn(into, F.lit(None).cast(_HIT))


def first_keyword(lowered: Column, keywords: Sequence[str]) -> Column:
    """The same for a short list that is known beforehand, as one expression: null when none occurs."""
    hit = F.lit(None).cast("string")
    for keyword in reversed(keywords):
        hit = F.when(F.contains(lowered, F.lit(keyword.lower())), F.lit(keyword)).otherwise(hit)
    return hit
