"""J3 for tables of any size: titles of one table that resemble a title of another.

Two titles resemble each other when ``2 * M / T`` reaches the threshold, M being the characters in their matching
blocks and T those of both. All pairs aren't compared: titles meet on q-grams, and what a pair of such similarity
must fulfil leaves few to compare.

* Length: M is at most the shorter title, so the longer one is at most (2 - threshold) / threshold times as long.
* Count: a character outside the blocks spoils at most q grams of its own title and q - 1 of the other, so at least
  ``(2q - 1) M - (q - 1) T - q + 1`` grams are common (repeats numbered). Grams are ordered, rare ones first; then two
  titles that have c common grams share one among the first (grams - c + 1) of each, and only those are indexed.
* Place: a gram that occurs once in both titles and lies in a block is shifted by no more than the characters left out
  before it.
* Signatures: parities of characters and of pairs of characters in 128 bits each; every bit that differs stands for at
  least one character (pair) without a partner, and at most T - 2M (three times as many) may lack one.

All four are necessary conditions, so nothing is lost; what is left is compared once. Short titles have too few long
grams: 3-grams serve pairs whose shorter title is long enough, 2-grams and single characters the rest. Where fewer pairs meet
without the long grams (titles with long runs in common), these are left out.

The order of grams needs their frequencies, kept as sums over ``BUCKETS`` hash buckets, a table of fixed size. A gram
of which there are more than ``POSTINGS`` is dealt to several tasks by the known title. Equal titles are
found by an equi-join before.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine import fixed_values as fv
from vitrine.functions.text import normalize_title
from vitrine.shared import run_folder, write_out

BUCKETS, POSTINGS = 1 << 16, 20_000
LONGEST = 1_000
_GRAM = {"q": "int", "token": "long", "salt": "int", "place": "int", "once": "boolean", "n": "int", "id": "long",
         "c1": "long", "c2": "long", "g1": "long", "g2": "long"}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def least_matched(total: int, threshold: float) -> int:
    """The fewest matched characters with which two titles of ``total`` characters resemble each other."""
    return ceil(threshold * total / 2 - 1e-9)


def common_grams(n: int, m: int, q: int, threshold: float) -> int:
    """q-grams that two similar titles of n and m characters have in common at least."""
    return (2 * q - 1) * least_matched(n + m, threshold) - (q - 1) * (n + m) - q + 1


class Plan:
    """Which grams serve which lengths: ``least[q]`` is the shorter title's length from which on q-grams do."""

    def __init__(self, threshold: float, sizes: tuple[int, ...] = (3, 2, 1)):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold lies between 0 and 1")
        self.threshold, self.least = threshold, {}
        above = None  # lengths from here on are served by longer grams
        for q in sizes:
            # two common grams at least are asked of long grams, else they would hardly be rarer than short ones
            fits = [n for n in range(1, LONGEST + 1) if common_grams(n, n, q, threshold) < (1 if q == 1 else 3)]
            start = 1 if q == 1 else max(fits, default=0) + 1
            if start <= LONGEST // 2 and (above is None or start < above):
                self.least[q] = (start, above)
                above = start

    def partners(self, n: int) -> tuple[int, int]:
        return ceil(n * self.threshold / (2 - self.threshold) - 1e-9), int(n * (2 - self.threshold) / self.threshold + 1e-9)

    @lru_cache(maxsize=100_000)
    def common(self, n: int, q: int) -> int:
        """Common grams with any partner that q-grams serve; 0 when there is none."""
        start, end = self.least[q]
        low, high = self.partners(n)
        if n < start or (end is not None and low >= end):
            return 0
        # the bound grows with the partner's length but for rounding
        near = [m for m in range(max(low, start), high + 1) if end is None or min(n, m) < end][:4]
        return max(0, min((common_grams(n, m, q, self.threshold) for m in near), default=0))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Grams:
    """The numbered q-grams of a batch of titles: owner, place, token, and whether it occurs once in its title."""

    def __init__(self, titles: list[str], q: int):
        codes = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.sizes = np.array([len(t) for t in titles], np.int64)
        ends = np.cumsum(self.sizes)
        owner = np.repeat(np.arange(len(titles)), self.sizes)
        place = np.arange(len(codes)) - (ends - self.sizes)[owner]
        fit = place + q <= self.sizes[owner]
        at = np.flatnonzero(fit)
        value = np.full(len(at), np.uint64(q))
        for k in range(q):
            value = _mixed(value * _M1 + codes[at + k])
        order = np.lexsort((value, owner[at]))
        self.owner, self.place, value = owner[at][order], place[at][order], value[order]
        new = np.ones(len(order), bool)
        new[1:] = (value[1:] != value[:-1]) | (self.owner[1:] != self.owner[:-1])
        starts = np.flatnonzero(new)
        length = np.diff(np.append(starts, len(order)))
        number = np.arange(len(order)) - np.repeat(starts, length)
        self.once = np.repeat(length, length) == 1
        self.token = _mixed(value + number.astype(np.uint64) * _M1)

    def bucket(self) -> np.ndarray:
        return (self.token % np.uint64(BUCKETS)).astype(np.int64)

    def parities(self) -> np.ndarray:
        """(titles, 2) signed 64-bit numbers."""
        n = len(self.sizes)
        counts = np.bincount(self.owner * 128 + (self.token % np.uint64(128)).astype(np.int64), minlength=n * 128)
        return np.packbits((counts & 1).astype(np.uint8).reshape(n, 128), axis=1).view(np.int64).reshape(n, 2)


def _titles_of(batch: pa.RecordBatch) -> list[str]:
    return batch.column("norm").to_pylist()


def _frequencies(norms: DataFrame, plan: Plan) -> np.ndarray:
    """How many indexed grams fall into each bucket; the longest list of a table of fixed size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            titles = _titles_of(batch)
            for q in plan.least:
                total += np.bincount(Grams(titles, q).bucket(), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    found = norms.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _first_grams(titles: list[str], plan: Plan, frequencies: np.ndarray) -> Iterator[tuple[int, Grams, np.ndarray]]:
    """Per size of gram the grams of a batch and the places of those to be indexed, the rarest of every title."""
    for q in plan.least:
        grams = Grams(titles, q)
        common = np.array([plan.common(int(n), q) for n in grams.sizes], np.int64)
        order = np.lexsort((grams.token, frequencies[grams.bucket()], grams.owner))
        owner = grams.owner[order]
        own = np.bincount(owner, minlength=len(titles))
        rank = np.arange(len(owner)) - (np.cumsum(own) - own)[owner]
        yield q, grams, order[(common[owner] > 0) & (rank < own[owner] - common[owner] + 1)]


def _meetings(new: DataFrame, known: DataFrame, plan: Plan, frequencies: np.ndarray) -> float:
    """How many pairs of indexed grams would meet, by buckets."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            titles = _titles_of(batch)
            if titles:
                for _, grams, kept in _first_grams(titles, plan, frequencies):
                    total += np.bincount(grams.bucket()[kept], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    def counts(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("norm").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").cast("double").alias(name))

    met = counts(new, "a").join(counts(known, "b"), "bucket").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    return met or 0.0


def _cheapest(new: DataFrame, known: DataFrame, threshold: float) -> tuple[Plan, np.ndarray]:
    """The plan under which the fewest grams meet, with its frequencies. Long grams are rarer, but more of them must be
    indexed; titles that share a long run meet on it, and would do so in pairs without end."""
    plans = {tuple(p.least): p for p in (Plan(threshold, sizes) for sizes in ((3, 2, 1), (2, 1), (1,)))}
    best = None
    for plan in plans.values():
        frequencies = _frequencies(new.select("norm").union(known.select("norm")), plan)
        met = _meetings(new, known, plan, frequencies)
        if best is None or met < best[0]:
            best = met, plan, frequencies
    return best[1:]


def _index(norms: DataFrame, plan: Plan, frequencies: np.ndarray, known: bool) -> DataFrame:
    """A row per indexed gram of each title. The known side of a common gram is dealt out, the other one copied."""
    parts = -(-frequencies // POSTINGS)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles = _titles_of(batch)
            if not titles:
                continue
            ids = batch.column("id").to_numpy()
            signs = np.hstack([Grams(titles, q).parities() for q in (1, 2)])
            for q, grams, kept in _first_grams(titles, plan, frequencies):
                deal = parts[grams.bucket()[kept]]
                if known:
                    salt = (_mixed(ids[grams.owner[kept]].astype(np.uint64)) % np.maximum(deal, 1).astype(np.uint64)).astype(np.int64)
                else:
                    kept = np.repeat(kept, deal)
                    salt = np.arange(len(kept)) - np.repeat(np.cumsum(deal) - deal, deal)
                owner = grams.owner[kept]
                columns = [np.full(len(kept), q), grams.token[kept].view(np.int64), salt, grams.place[kept], grams.once[kept],
                           grams.sizes[owner], ids[owner], *signs[owner].T]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, _ARROW[k]) for c, k in zip(columns, _GRAM.values())], names=list(_GRAM))

    return norms.mapInArrow(index, ", ".join(f"{c} {k}" for c, k in _GRAM.items()))


def _candidates(new: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Pairs of indexed titles that fulfil the necessary conditions: id, other."""
    left, right = new, known
    plan, frequencies = _cheapest(left, right, threshold)
    a = _index(left, plan, frequencies, known=False).alias("a")
    b = _index(right, plan, frequencies, known=True).alias("b")
    total = F.col("a.n") + F.col("b.n")
    least = F.ceil(total * threshold / 2 - 1e-9)
    differ = lambda kind: (F.bit_count(F.col(f"a.{kind}1").bitwiseXOR(F.col(f"b.{kind}1")))
                           + F.bit_count(F.col(f"a.{kind}2").bitwiseXOR(F.col(f"b.{kind}2"))))
    shift = F.col("a.place") - F.col("b.place")
    near = shift.between(-(F.col("b.n") - least), F.col("a.n") - least)
    on = ((F.col("a.q") == F.col("b.q")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.salt") == F.col("b.salt"))
          & (least <= F.least("a.n", "b.n")) & (~(F.col("a.once") & F.col("b.once")) | near)
          & (differ("c") <= total - 2 * least) & (differ("g") <= 3 * (total - 2 * least)))
    return a.join(b, on).select(F.col("a.id").alias("id"), F.col("b.id").alias("other")).distinct()


def _compared(pairs: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (norm, other_norm) whose similarity reaches the threshold, with it as ``ratio``."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = SequenceMatcher(None)
        for pair in batches:
            ratios = []
            for title, other in zip(pair["norm"], pair["other_norm"]):
                if matcher.b != other:
                    matcher.set_seq2(other)  # indexed once for all titles in a row
                matcher.set_seq1(title)
                ratios.append(matcher.ratio() if matcher.quick_ratio() >= threshold else 0.0)
            yield pair.assign(ratio=ratios)

    return pairs.mapInPandas(compare, "norm string, other_norm string, ratio double").filter(F.col("ratio") >= threshold)


def similar_pairs(new: DataFrame, known: DataFrame, threshold: float = fv.SIMILARITY) -> DataFrame:
    """Pairs of different titles of two tables (normalised titles ``norm``) that resemble each other: norm, other_norm,
    ratio. Each pair of titles comes once, however often they occur."""
    folder = run_folder(new.sparkSession, "titles")
    named = lambda rows, name: write_out(rows.select("norm").filter("norm is not null").distinct().withColumn(
        "id", F.xxhash64("norm")), folder, name)
    left, right = named(new, "new"), named(known, "known")
    pairs = write_out(_candidates(left, right, threshold), folder, "candidates")
    # two titles of one id both come back here and are told apart by the comparison
    texts = pairs.join(left, "id").join(right.select(F.col("id").alias("other"), F.col("norm").alias("other_norm")), "other")
    ordered = texts.filter("norm <> other_norm").select("norm", "other_norm")
    return _compared(ordered, threshold)


def unlike_known(offers: DataFrame, known: DataFrame, threshold: float = fv.SIMILARITY) -> DataFrame:
    """J3. Offers whose title resembles no title of ``known`` (both with ``title``), compared in normalised form.

    Offers without a title resemble none. Titles that are known word for word leave before any comparison.
    """
    folder = run_folder(offers.sparkSession, "unlike")
    normal = F.col("title").alias("_raw"), normalize_title(F.col("title")).alias("norm")
    seen = write_out(known.select(normal[1]).filter("norm is not null").distinct(), folder, "known")
    asked = write_out(offers.select(*normal).filter("norm is not null").distinct(), folder, "asked")
    fresh = write_out(asked.select("norm").distinct().join(seen, "norm", "left_anti"), folder, "fresh")
    alike = similar_pairs(fresh, seen, threshold).select("norm").distinct()
    dull = asked.join(fresh.join(alike, "norm", "left_anti"), "norm", "left_anti").select(F.col("_raw").alias("title"))
    return offers.join(dull, "title", "left_anti").select(*offers.columns)
