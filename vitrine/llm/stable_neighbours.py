"""Approximate nearest neighbours: stable projections in kd-trees with a chi-square stopping test.

Vectors are projected by a Gaussian matrix onto few dimensions. For a vector at distance d the squared projected
distance, divided by d squared, follows the chi-square law with as many degrees of freedom. So candidates are taken
in the order of projected distance and verified on the original vectors; once the next projected distance is so
large that a vector nearer than the k-th found would have shown up before with probability ``sure``, the search
stops.

Layout: the upper levels of the kd-tree are fitted on a bounded sample of projections (``SAMPLE`` rows) and cut
the space into cells; every vector belongs to one. A cell is dealt to tasks in parts of bounded rows, so a cell
that a common vector makes large is no larger task. A query first searches its own cell; the k-th distance found
there gives the radius of the stopping test, and the query then visits just the cells that reach into it. Inside
a part, a kd-tree of small leaves gives the candidates.

Queries are rows like any other and are shuffled to the cells they visit; the sample and the boxes of at most
``CELLS`` cells are all that reaches every task.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
vectors of a length other than the commonest, nor rows without vec_id; rows of one vec_id are candidates once, at
their nearest, and one query; a vec_id is no candidate of itself; with fewer than k candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vitrine.llm.common import tasks_of
from vitrine.shared import run_folder, write_out

DIMENSIONS, SAMPLE, CELLS, CELL_ROWS, PART_ROWS, LEAF = 8, 20_000, 1_024, 4_000, 20_000, 32


def stop_ratio(sure: float, m: int) -> float:
    """The chi-square quantile for an even number of degrees of freedom, by bisection of its closed form."""
    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for k in range(1, m // 2):
            term *= x / 2 / k
            total += term
        return 1 - np.exp(-x / 2) * total

    low, high = 0.0, 1e4
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < sure else (low, mid)
    return high


def projection(length: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, m))


class Cells:
    """Upper levels of the kd-tree over a sample: a cut per inner node, a box per cell."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.cuts: list[tuple[int, float]] = []
        self.depth = max(0, int(np.ceil(np.log2(max(1, cells)))))
        m = sample.shape[1]
        level = [(sample, np.full(m, -np.inf), np.full(m, np.inf))]
        for _ in range(self.depth):
            below = []
            for rows, low, high in level:
                axis = int(np.ptp(rows, axis=0).argmax()) if len(rows) else 0
                at = float(np.median(rows[:, axis])) if len(rows) else 0.0
                self.cuts.append((axis, at))
                left, right = high.copy(), low.copy()
                left[axis], right[axis] = min(at, high[axis]), max(at, low[axis])
                below += [(rows[rows[:, axis] < at], low, left), (rows[rows[:, axis] >= at], right, high)]
            level = below
        self.low, self.high = np.array([x[1] for x in level]), np.array([x[2] for x in level])
        self.axis, self.at = np.array([c[0] for c in self.cuts], int), np.array([c[1] for c in self.cuts])

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - (2 ** self.depth - 1)

    def reach(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of every cell's box."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(axis=1)


class Tree:
    """A kd-tree of small leaves over the projections of one part."""

    def __init__(self, points: np.ndarray):
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            own = points[rows]
            axis = int(np.ptp(own, axis=0).argmax())
            order = np.argpartition(own[:, axis], len(rows) // 2)
            todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
        self.points, self.leaves = points, leaves
        self.low = np.array([points[rows].min(axis=0) for rows in leaves])
        self.high = np.array([points[rows].max(axis=0) for rows in leaves])

    def nearest(self, point: np.ndarray, vector: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: int, k: int,
                ratio: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the k nearest found. ``bound``: the k-th squared distance known so far."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        reach = (gap * gap).sum(axis=1)
        order = np.argsort(reach)
        best_id, best = np.zeros(0, np.int64), np.zeros(0)
        at, width = 0, 4
        while at < len(order):
            limit = bound if len(best) < k else min(bound, best[-1])
            if reach[order[at]] > ratio * limit:
                break  # the stopping test holds for all that is left
            rows = np.concatenate([self.leaves[i] for i in order[at:at + width]])
            at, width = at + width, width * 2
            near = self.points[rows] - point
            rows = rows[((near * near).sum(axis=1) <= ratio * limit) & (ids[rows] != own)]
            if not len(rows):
                continue
            off = vectors[rows] - vector
            best = np.append(best, (off * off).sum(axis=1))
            best_id = np.append(best_id, ids[rows])
            top = np.lexsort((best_id, best))
            top = top[np.sort(np.unique(best_id[top], return_index=True)[1])][:k]
            best, best_id = best[top], best_id[top]
        return best_id, best


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    fit = (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", numbers.alias("embedding")).where("vec_id is not null and embedding is not null")
    return rows.where(fit & F.exists("embedding", lambda x: x != 0))


def _arrays(frame: pd.DataFrame, name: str) -> np.ndarray:
    return np.array(frame[name].tolist(), float)


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, sure: float = 0.97, m: int = DIMENSIONS,
               seed: int = 7) -> DataFrame:
    """The k nearest found of each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    folder, result = run_folder(spark, "neighbours"), "query_id long, vec_id long, square double"
    clean = usable(vectors)
    common = clean.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = common["n"] if common else 1
    count = common["count"] if common else 0
    matrix, ratio = projection(length, m, seed), stop_ratio(sure, m)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                yield frame.assign(near=list(_arrays(frame, "embedding") @ matrix))

    placed = write_out(clean.where(F.size("embedding") == length).mapInPandas(
        project, "vec_id long, embedding array<double>, near array<double>"), folder, "projected")
    share = min(1.0, SAMPLE / max(1, count))
    sample = placed.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)).select(
        "near").limit(2 * SAMPLE).toPandas()
    cells = Cells(_arrays(sample, "near") if len(sample) else np.zeros((0, m)), min(CELLS, -(-count // CELL_ROWS)))

    @F.pandas_udf("int")
    def cell_of(near: pd.Series) -> pd.Series:
        return pd.Series(cells.of(np.array(near.tolist(), float).reshape(-1, m)), index=near.index)

    located = write_out(placed.withColumn("cell", cell_of("near")), folder, "located")
    # a large cell is dealt to several tasks; a query goes to each of them
    parts = located.groupBy("cell").count().select("cell", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts"))
    index = located.join(parts, "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "embedding", "near")
    queries = write_out(located.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), folder, "queries")

    def search(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            ids, body, tree = held["vec_id"].to_numpy(), _arrays(held, "embedding"), Tree(_arrays(held, "near"))
            for q, vector, near, bound in zip(asked["vec_id"], asked["embedding"], asked["near"], asked["bound"]):
                found, square = tree.nearest(np.asarray(near, float), np.asarray(vector, float), body, ids, q, k, ratio, bound)
                out.append(pd.DataFrame({"query_id": q, "vec_id": found, "square": square}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "square": []})

    def visit(asked: DataFrame) -> DataFrame:
        """``asked``: vec_id, embedding, near, bound, cell."""
        asked = asked.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return asked.groupBy("cell", "part").cogroup(index.groupBy("cell", "part")).applyInPandas(search, result)

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.min("square").alias("square"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("square", "vec_id"))
        return once.withColumn("rank", place).where(F.col("rank") <= k)

    home = write_out(visit(queries.withColumn("bound", F.lit(float("inf")))), folder, "home")
    bounds = best(home).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("square").alias("bound"))

    @F.pandas_udf("array<int>")
    def others(near: pd.Series, cell: pd.Series, bound: pd.Series) -> pd.Series:
        return pd.Series([[i for i in np.flatnonzero(cells.reach(np.asarray(p, float)) <= ratio * b).tolist() if i != own]
                          for p, own, b in zip(near, cell, bound)], index=near.index)

    again = queries.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    again = again.withColumn("cell", F.explode(others("near", "cell", "bound")))
    ranked = best(home.union(visit(again)))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("square").alias("score"))
