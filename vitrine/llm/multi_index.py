"""Hard-negative mining by an inverted multi-index.

A vector is cut into two halves, and each half has a codebook of its own (k-means on a bounded sample of ``SAMPLE``
rows; every row is indexed). The pair of nearest codes is the cell of a vector. For an anchor, a cell's inner products
are bounded by a sum of two half scores: the half's product with the code plus the half's length times the largest
distance of a vector from that code. Two sorted lists of half scores and a heap (the multi-sequence algorithm) give
the cells in descending order of that bound.

Positives: an anchor first visits cells until ``FIRST_ROWS`` rows are seen. Its k-th score so far is certified once no
unvisited cell's bound reaches it, so the second round visits just the cells that do. Negatives: the same, with the
windows of scores that the positives give: cells wholly above all windows hold none, and a window is certified when
the bound falls below its k-th score, or below the window. Results are therefore exact, whatever the codebooks.

Layout: a cell is dealt to tasks in parts of ``PART_ROWS`` rows, and the anchors that visit it in groups of
``ASKED_ROWS``, so neither a common vector nor the growing number of anchors makes a task large. Codes are whole
numbers and products are computed exactly, so every task sees the same order of cells. What reaches the driver and
every task is two codebooks and one row per cell, ``CODES`` squared at most.

Defined cases: rows with a null id, label or vector, or with null or non-finite components take no part; nor do empty
vectors, vectors of a length other than the commonest, and vectors with a component of 2^19 or more, whose scores need
not fit a long. Rows of one id count once, that of the smallest label, then vector. Equal scores go by the smaller id.
An anchor without positives, or a positive whose window is empty, gives no row. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vitrine.shared import run_folder, write_out

SAMPLE, CODES, CELL_ROWS, FIRST_ROWS, PART_ROWS, ASKED_ROWS = 20_000, 32, 500, 2_000, 20_000, 20_000
SCALE, MOST = 256, 2.0 ** 19
BLOCK_SCORES = 4_000_000


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0 ** 52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def codebook(rows: np.ndarray, codes: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k-means with centres rounded to whole numbers."""
    if not len(rows):
        return np.zeros((1, rows.shape[1]), np.int64)
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(codes, len(rows)), replace=False)].astype(float)
    for _ in range(rounds):
        near = np.argmin((centres ** 2).sum(axis=1) - 2 * rows @ centres.T, axis=1)
        for k in range(len(centres)):
            own = rows[near == k]
            if len(own):
                centres[k] = own.mean(axis=0)
    return np.unique(np.rint(centres).astype(np.int64), axis=0)


class Halves:
    """The two codebooks, and per cell its rows and radii once they are known."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.cut = sample.shape[1] // 2
        self.books = codebook(sample[:, :self.cut], codes), codebook(sample[:, self.cut:], codes)
        self.wide = len(self.books[1])
        self.cells = len(self.books[0]) * self.wide

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row, and the squared distances of its halves from their codes."""
        cell, square = np.zeros(len(rows), np.int64), np.zeros((len(rows), 2))
        for h, (half, book) in enumerate(zip((rows[:, :self.cut], rows[:, self.cut:]), self.books)):
            near = np.argmin((book.astype(float) ** 2).sum(axis=1) - 2.0 * product(half, book), axis=1)
            cell = cell * (self.wide if h else 1) + near
            square[:, h] = ((half - book[near]).astype(float) ** 2).sum(axis=1)
        return cell, square

    def know(self, counts: dict[int, tuple[int, float, float]]) -> None:
        """``counts``: per cell its rows and the largest squared distances of the halves."""
        shape = len(self.books[0]), self.wide
        self.rows, self.radii = np.zeros(shape, np.int64), np.zeros((2, *shape))
        for cell, (n, first, second) in counts.items():
            at = divmod(cell, self.wide)
            # a little more than the root, so that rounding never makes a bound too small
            self.rows[at], self.radii[(0, *at)], self.radii[(1, *at)] = n, np.sqrt(first) * (1 + 1e-9), np.sqrt(second) * (1 + 1e-9)
        self.code_radii = self.radii[0].max(axis=1), self.radii[1].max(axis=0)

    def ordered(self, halves: list[np.ndarray]) -> Iterator[tuple[float, int, int]]:
        """The multi-sequence: pairs of codes by descending sum of half bounds."""
        first, second = (np.argsort(-u, kind="stable").tolist() for u in halves)
        a, b = halves[0][first].tolist(), halves[1][second].tolist()
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield -bound, first[i], second[j]
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))

    def visit(self, vector: np.ndarray, skip: int, floor: float, ceiling: float, need: float) -> tuple[list[int], int]:
        """Cells that may hold scores from ``floor`` to ``ceiling``, beyond the first ``skip`` of the order.

        It ends when ``need`` rows lie in them. Also gives the number of pairs taken from the order.
        """
        parts = vector[:self.cut], vector[self.cut:]
        length = [float(np.sqrt(float((p.astype(np.int64) ** 2).sum()))) * (1 + 1e-9) for p in parts]
        scores = [product(p[None, :], book)[0].astype(float) for p, book in zip(parts, self.books)]
        slack = 1e-9 * sum(float(np.abs(s).max()) for s in scores) + 1e-6
        found, taken, held = [], 0, 0
        for bound, i, j in self.ordered([s + n * r for s, n, r in zip(scores, length, self.code_radii)]):
            if bound + slack < floor:
                break
            taken += 1
            if taken <= skip or not self.rows[i, j]:
                continue
            centre = scores[0][i] + scores[1][j]
            reach = length[0] * self.radii[0, i, j] + length[1] * self.radii[1, i, j] + slack
            if centre + reach < floor or centre - reach > ceiling:
                continue
            found.append(i * self.wide + j)
            held += int(self.rows[i, j])
            if held >= need:
                break
        return found, taken


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the components as whole numbers, of the rows that take part."""
    fit = (F.size("embedding") > 0) & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= MOST))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(fit)
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), numbers.alias("v"))


def relabelled(vectors: DataFrame, every: int = 7, classes: int = 10) -> DataFrame:
    """Rows whose id is divisible by ``every`` move to the next label."""
    return vectors.withColumn("label", F.when(
        F.col("vec_id") % every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label")))


def _matrix(bodies: list[bytes], kind: str, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(bodies), kind).reshape(-1, length)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by id."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10,
                   window: tuple[int, int] = (30, 90), codes: int = CODES) -> DataFrame:
    """``rows``: vec_id, label, v (whole numbers). For each row whose id is divisible by ``every`` and each of its
    best rows of the same label, the best rows of other labels whose score lies within ``window`` per cent of the
    positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark, folder = rows.sparkSession, run_folder(rows.sparkSession, "multi-index")
    common = rows.groupBy(F.size("v").alias("n")).agg(
        F.count("*").alias("rows"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy(F.desc("rows"), "n").first()
    length, most = (common["n"], common["most"]) if common else (1, 1)
    kind = "<i2" if most < 2 ** 15 else "<i4"
    single = rows.where(F.size("v") == length).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row"))
    once = write_out(single.select("vec_id", "row.label", "row.v"), folder, "rows")
    count = once.count()
    share = min(1.0, SAMPLE / max(1, count))
    sample = once.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20)).select(
        "v").limit(2 * SAMPLE).toPandas()
    fitted = np.array(sample["v"].tolist(), np.int64).reshape(-1, length)
    index = Halves(fitted, int(min(codes, max(1, round((count / CELL_ROWS) ** 0.5)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column("v").flatten().to_numpy().reshape(-1, length)
            cell, square = index.place(body.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(cell), pa.array(square[:, 0]), pa.array(square[:, 1]),
                 pa.array([r.tobytes() for r in body.astype(kind)], pa.binary())],
                names=["vec_id", "label", "cell", "first", "second", "body"])

    placed = write_out(once.mapInArrow(
        place, "vec_id long, label long, cell long, first double, second double, body binary"), folder, "placed")
    known = placed.groupBy("cell").agg(F.count("*"), F.max("first"), F.max("second")).collect()
    index.know({r[0]: (r[1], r[2], r[3]) for r in known})
    parts = [0] * index.cells
    for r in known:
        parts[r[0]] = -(-r[1] // PART_ROWS)
    parts_of = F.element_at(F.array(*[F.lit(p) for p in parts]), (F.col("cell") + 1).cast("int"))
    anchors = placed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "body")
    anchors = write_out(anchors, folder, "anchors")
    groups = max(1, -(-anchors.count() // ASKED_ROWS))
    held = placed.select(
        "cell", F.pmod(F.xxhash64("vec_id"), parts_of).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("sub"), "vec_id", "label", "body")

    @F.pandas_udf("cells array<long>, taken int")
    def route(body: pd.Series, skip: pd.Series, floor: pd.Series, ceiling: pd.Series, need: pd.Series) -> pd.DataFrame:
        out = [index.visit(np.frombuffer(b, kind), int(s), f, c, n) for b, s, f, c, n in zip(body, skip, floor, ceiling, need)]
        return pd.DataFrame({"cells": [x[0] for x in out], "taken": [x[1] for x in out]})

    def asked(given: DataFrame, name: str) -> DataFrame:
        """Adds the cells to be visited; from ``skip``, ``floor`` and ``ceiling`` (null: no limit) and ``need``."""
        limit = lambda c, x: F.coalesce(F.col(c).cast("double"), F.lit(x))
        way = route("body", "skip", limit("floor", float("-inf")), limit("ceiling", float("inf")), limit("need", float("inf")))
        return write_out(given.withColumn("way", way), folder, name)

    def search(given: DataFrame, task, result: str) -> DataFrame:
        to = given.withColumn("cell", F.explode("way.cells")).drop("way", "skip", "floor", "ceiling", "need")
        to = to.withColumn("part", F.explode(F.sequence(F.lit(0), parts_of - 1))).withColumn(
            "sub", F.pmod(F.xxhash64("anchor_id"), F.lit(groups)).cast("int"))
        by = ("cell", "part", "sub")
        return to.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(task, result)

    def scores_of(ask: pa.Table, hold: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per anchor of ``ask`` its row number, and the ids, labels and scores of the rows held."""
        ids, labels = hold["vec_id"].to_numpy(), hold["label"].to_numpy()
        body = _matrix(hold["body"].to_pylist(), kind, length)
        own = _matrix(ask["body"].to_pylist(), kind, length)
        step = max(1, BLOCK_SCORES // max(1, len(ids)))
        for start in range(0, len(own), step):
            for k, row in enumerate(product(own[start:start + step], body), start):
                yield k, ids, labels, row

    def table_of(rows: list, names: list[str]) -> pa.Table:
        columns = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in range(len(names))]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    def same_label(ask: pa.Table, hold: pa.Table) -> pa.Table:
        out = []
        if len(ask) and len(hold):
            who, label = ask["anchor_id"].to_numpy(), ask["label"].to_numpy()
            least = ask["least"].to_pylist()
            for k, ids, labels, scores in scores_of(ask, hold):
                fit = (labels == label[k]) & (ids != who[k])
                at = np.flatnonzero(fit if least[k] is None else fit & (scores >= least[k]))
                at = at[_top(scores[at], ids[at], positives)]
                out.append((np.full(len(at), who[k]), ids[at], scores[at]))
        return table_of(out, ["anchor_id", "positive_id", "positive_score"])

    def other_label(ask: pa.Table, hold: pa.Table) -> pa.Table:
        out = []
        if len(ask) and len(hold):
            who, label, windows = ask["anchor_id"].to_numpy(), ask["label"].to_numpy(), ask["windows"].to_pylist()
            for k, ids, labels, scores in scores_of(ask, hold):
                other = np.flatnonzero(labels != label[k])
                own = scores[other]
                for w in windows[k]:
                    at = other[(own >= w["low"]) & (own <= w["high"])]
                    at = at[_top(scores[at], ids[at], negatives)]
                    out.append((np.full(len(at), who[k]), np.full(len(at), w["positive_id"]), ids[at], scores[at]))
        return table_of(out, ["anchor_id", "positive_id", "negative_id", "negative_score"])

    def best(found: DataFrame, by: list[str], score: str, vec_id: str, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), vec_id))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    none, zero = F.lit(None).cast("long"), F.lit(0)
    # positives
    kind_of = "anchor_id long, positive_id long, positive_score long"
    first = asked(anchors.withColumns({"skip": zero, "floor": none, "ceiling": none, "need": F.lit(FIRST_ROWS)}), "to-positives-1")
    near = write_out(search(first.withColumn("least", none), same_label, kind_of), folder, "positives-1")
    best_of = lambda found: best(found, ["anchor_id"], "positive_score", "positive_id", positives)
    bounds = best_of(near).where(F.col("rank") == positives).select("anchor_id", F.col("positive_score").alias("least"))
    again = first.select("anchor_id", "label", "body", F.col("way.taken").alias("skip")).join(bounds, "anchor_id", "left")
    second = asked(again.withColumns({"floor": F.col("least"), "ceiling": none, "need": none}), "to-positives-2")
    liked = write_out(best_of(near.union(search(second, same_label, kind_of))).drop("rank"), folder, "positives")
    # windows of whole scores, empty ones left out; per anchor as many as positives at most
    hundredths = lambda p: F.col("positive_score") * p
    framed = liked.withColumns({
        "low": -F.floor(-hundredths(window[0]) / 100).cast("long"), "high": F.floor(hundredths(window[1]) / 100).cast("long")})
    framed = framed.withColumns({  # the division is one of doubles: put right what it rounds
        "low": F.when(F.col("low") * 100 < hundredths(window[0]), F.col("low") + 1).when(
            (F.col("low") - 1) * 100 >= hundredths(window[0]), F.col("low") - 1).otherwise(F.col("low")),
        "high": F.when(F.col("high") * 100 > hundredths(window[1]), F.col("high") - 1).when(
            (F.col("high") + 1) * 100 <= hundredths(window[1]), F.col("high") + 1).otherwise(F.col("high"))})
    framed = framed.where("low <= high")
    per_anchor = lambda f: f.groupBy("anchor_id").agg(
        F.collect_list(F.struct("positive_id", "low", "high")).alias("windows"), F.min("low").alias("floor"), F.max("high").alias("ceiling"))
    kind_of = "anchor_id long, positive_id long, negative_id long, negative_score long"
    first = asked(anchors.join(per_anchor(framed), "anchor_id").withColumns({"skip": zero, "need": F.lit(FIRST_ROWS)}), "to-negatives-1")
    near = write_out(search(first, other_label, kind_of), folder, "negatives-1")
    best_of = lambda found: best(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    bounds = best_of(near).where(F.col("rank") == negatives).select("anchor_id", "positive_id", F.col("negative_score").alias("least"))
    raised = framed.join(bounds, ["anchor_id", "positive_id"], "left").withColumn("low", F.greatest("low", "least"))
    again = first.select("anchor_id", "label", "body", F.col("way.taken").alias("skip")).join(per_anchor(raised), "anchor_id")
    second = asked(again.withColumn("need", none), "to-negatives-2")
    mined = best_of(near.union(search(second, other_label, kind_of)))
    return mined.join(liked, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


MINED_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
  QUALIFY rank <= 10"""
