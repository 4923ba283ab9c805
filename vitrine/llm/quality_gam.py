"""Quality classifier: a generalised additive model with pairwise interactions.

The score of a text is the logistic of a sum of table entries: one table per feature and one per chosen pair of
features. Training goes round the features again and again; each time a shallow tree over the feature's bins is
fitted to the current residuals and a small part of it is added to the feature's table. Pairs are then picked by
how much residual a cut into four quadrants would explain, and boosted likewise. Scoring is nothing but bin
numbers and vectorised additions of table entries.

Features come from the whole text alone. The model is fitted on at most ``max_rows`` labelled documents, a
documented bound: they are the ones with the smallest hash of their id, so the choice doesn't depend on layout.
The model (a few thousand numbers) travels with the tasks; texts are read once to fetch the labelled
documents and once to score, and nothing is shuffled but labels.

Defined cases: null and empty texts have no features (bin 0) and get a score like any other; labels that are
null, or that contradict each other for one id, are left out; labels other than 0 and 1 count by ``> 0``; without
labels of both kinds every score is the share of label 1 (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

FEATURES = (
    "chars", "words", "word_length", "longest_word", "upper", "digits", "white", "punctuation", "symbols", "calls",
    "non_ascii", "distinct_words", "top_word", "distinct_pairs", "short_words", "odd_words", "lines", "line_length",
    "repeated_lines", "ended_lines", "piped_lines", "byte_entropy", "sentence_words", "links",
)
BINS, PAIR_BINS = 48, 12
_WORDLIKE = re.compile(r"\w[\w'’-]*[.,;:!?)]?|\(?\w[\w'’-]*")
_KIND = np.zeros((256, 6), np.float32)  # upper, digit, white, punctuation, symbol, beyond ASCII
for _c in range(256):
    _KIND[_c] = (65 <= _c <= 90, 48 <= _c <= 57, chr(_c) in " \t\n\r\f\v", chr(_c) in ".,;:!?'\"()-",
                 chr(_c) in "#$%&*@^~|<>=+\\/[]{}_`", _c >= 128)


def features(text: str) -> list[float]:
    """The numbers of one whole text; an empty text has none."""
    nothing = [float("nan")] * len(FEATURES)
    words = text.split()
    if not words:
        return nothing
    body = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    n, shares = len(body), counts @ _KIND / len(body)
    met = counts[counts > 0] / n
    n_words, seen = len(words), Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    pairs = len(set(zip(words, words[1:]))) / max(1, n_words - 1)
    sizes = [len(w) for w in words]
    ends = counts[46] + counts[33] + counts[63]
    wordlike = sum(c for w, c in seen.items() if _WORDLIKE.fullmatch(w))
    return [
        np.log1p(len(text)), np.log1p(n_words), sum(sizes) / n_words, np.log1p(max(sizes)), *shares[:5].tolist(),
        (counts[33] + counts[63]) / n, float(shares[5]), len(seen) / n_words ** 0.8, max(seen.values()) / n_words,
        pairs, sum(s <= 3 for s in sizes) / n_words, 1 - wordlike / n_words, np.log1p(len(lines)),
        np.log1p(len(text) / len(lines)), 1 - len(set(lines)) / len(lines),
        sum(line.rstrip()[-1] in ".!?:;\"'" for line in lines) / len(lines), sum("|" in line for line in lines) / len(lines),
        float(-(met * np.log2(met)).sum()), n_words / (1 + ends), (text.count("http") + text.count("www.")) / n_words]


def matrix(texts: Sequence[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], float).reshape(-1, len(FEATURES))


def _shallow(gain: np.ndarray, weight: np.ndarray, cuts: int, least: float) -> np.ndarray:
    """A tree of ``cuts`` cuts over ordered bins: the Newton step of each bin's leaf."""
    edges = [0, len(gain)]
    g, h = np.append(0, np.cumsum(gain)), np.append(0, np.cumsum(weight))
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    for _ in range(cuts):
        best = (1e-9, 0)
        for a, b in zip(edges, edges[1:]):
            at = np.arange(a + 1, b)
            if len(at):
                value = worth(a, at) + worth(at, b) - worth(a, b)
                value[(h[at] - h[a] < least) | (h[b] - h[at] < least)] = -1
                k = int(value.argmax())
                best = max(best, (float(value[k]), int(at[k])))
        if not best[1]:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(gain))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _quadrants(gain: np.ndarray, weight: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """The best cut of a table of bins into four quadrants: its worth, and its steps."""
    g, h = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (gain, weight))
    total, best, at = g[-1, -1] ** 2 / (h[-1, -1] + 1.0), 0.0, None
    low = (g[1:-1, 1:-1], h[1:-1, 1:-1])
    top = (g[1:-1, -1:] - low[0], h[1:-1, -1:] - low[1])
    side = (g[-1:, 1:-1] - low[0], h[-1:, 1:-1] - low[1])
    far = (g[-1, -1] - low[0] - top[0] - side[0], h[-1, -1] - low[1] - top[1] - side[1])
    value = sum(a ** 2 / (b + 1.0) for a, b in (low, top, side, far)) - total
    steps = np.zeros_like(gain)
    if value.size and value.max() > 0:
        best = float(value.max())
        i, j = np.unravel_index(int(value.argmax()), value.shape)
        for rows, cols, (a, b) in ((slice(None, i + 1), slice(None, j + 1), low), (slice(None, i + 1), slice(j + 1, None), top),
                                   (slice(i + 1, None), slice(None, j + 1), side), (slice(i + 1, None), slice(j + 1, None), far)):
            if b[i, j] >= least:
                steps[rows, cols] = a[i, j] / (b[i, j] + 1.0)
    return best, steps


@dataclass
class Gam:
    """Tables of a fitted model; ``score`` adds their entries."""

    start: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def _bins(x: np.ndarray, cuts: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Bin 0 is for what is missing."""
        return [np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(c, x[:, k], "right")) for k, c in enumerate(cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for bins, entries in zip(self._bins(x, self.cuts), self.tables):
            total += entries[bins]
        coarse = self._bins(x, self.pair_cuts)
        for (a, b), entries in zip(self.pairs, self.pair_tables):
            total += entries[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 150, pairs: int = 8, rate: float = 0.1,
            cuts: int = 3, least: float = 2.0) -> Gam:
        share = float(y.mean()) if len(y) else 0.5
        model = cls()
        if share in (0.0, 1.0) or len(y) < 20:
            share = (share * len(y) + 0.5) / (len(y) + 1)
            model.start = float(np.log(share / (1 - share)))
            return model
        model.start = float(np.log(share / (1 - share)))
        edges = lambda column, n: np.unique(np.quantile(column[~np.isnan(column)], np.linspace(0, 1, n + 1)[1:-1])
                                            if (~np.isnan(column)).any() else np.zeros(0))
        model.cuts = [edges(x[:, k], BINS) for k in range(x.shape[1])]
        model.pair_cuts = [edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
        bins, coarse = cls._bins(x, model.cuts), cls._bins(x, model.pair_cuts)
        model.tables = [np.zeros(len(c) + 2) for c in model.cuts]
        total = np.full(len(y), model.start)
        for _ in range(rounds):
            for k, entries in enumerate(model.tables):
                p = 1 / (1 + np.exp(-total))
                step = rate * _shallow(np.bincount(bins[k], y - p, len(entries)),
                                       np.bincount(bins[k], p * (1 - p), len(entries)), cuts, least)
                entries += step
                total += step[bins[k]]

        def quadrants(a: int, b: int) -> tuple[float, np.ndarray]:
            shape = (len(model.pair_cuts[a]) + 2, len(model.pair_cuts[b]) + 2)
            cell, p = coarse[a] * shape[1] + coarse[b], 1 / (1 + np.exp(-total))
            return _quadrants(np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape),
                              np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape), least)

        every = [(quadrants(a, b)[0], a, b) for a in range(x.shape[1]) for b in range(a)]
        model.pairs = [(a, b) for _, a, b in sorted(every, reverse=True)[:pairs]]
        model.pair_tables = [np.zeros((len(model.pair_cuts[a]) + 2, len(model.pair_cuts[b]) + 2)) for a, b in model.pairs]
        for _ in range(rounds // 3):
            for (a, b), entries in zip(model.pairs, model.pair_tables):
                step = rate * quadrants(a, b)[1]
                entries += step
                total += step[coarse[a], coarse[b]]
        return model


def held_out(doc_id: Column) -> Column:
    """The fold that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000) -> Gam:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold."""
    known = (
        labels.select("doc_id", (F.col(label) > 0).cast("int").alias("y")).where("doc_id is not null and y is not null")
        .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top"))
        .where("y = top").select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # at most max_rows narrow rows
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "x": list(matrix(list(frame["text"])))})

    rows = (chosen.mapInPandas(run, "doc_id long, y int, x array<double>").dropDuplicates(["doc_id"])
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).toPandas())
    if not len(rows):
        return Gam.fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return Gam.fit(np.array(rows["x"].tolist(), float), rows["y"].to_numpy(float))


def scorer(model: Gam):
    """A column function: text to score."""
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(list(text))), index=text.index)
    return score


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    score = scorer(train(docs, labels, label))
    scored = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), score(docs["text"]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose score is at least ``least``, with all their columns."""
    return docs.where(scorer(train(docs, labels))(docs["text"]) >= least)
