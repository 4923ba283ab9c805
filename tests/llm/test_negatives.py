import math

import numpy as np
import pytest

from vitrine.llm import multi_index as mi

KIND = "vec_id long, embedding array<double>, label int, cell int, part int, body string"


def brute(rows, every=100):
    use = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or len(v) != 8 or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        use[i] = min(use.get(i, row), row)
    out = []
    for a, (label, v) in use.items():
        if a % every:
            continue
        scores = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in use.items() if i != a}
        best = lambda ids: sorted(ids, key=lambda i: (-scores[i], i))
        for p in best([i for i in scores if use[i][0] == label])[:5]:
            fit = [i for i in scores if use[i][0] != label and 30 * scores[p] <= 100 * scores[i] <= 90 * scores[p]]
            out += [(a, p, k, i, scores[p], scores[i]) for k, i in enumerate(best(fit)[:10], 1)]
    return sorted(out)


def mined(spark, rows, **how):
    table = spark.createDataFrame(rows, KIND)
    return sorted(map(tuple, mi.hard_negatives(mi.relabelled(mi.scaled(table)), **how).collect()))


def make(n, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 8))
    rows = [(i, (centres[i % 12] * 2 + spread * rng.standard_normal(8)).tolist(), int(rng.integers(0, 10)), 1, 2, "b") for i in range(n)]
    rows += [(5000 + i, rows[100][1], i % 10, 1, 2, "b") for i in range(60)]  # a common vector: ties go by id
    nan, inf = float("nan"), float("inf")
    rows += [(6000, None, 1, 1, 2, "b"), (6100, [1.0] * 8, None, 1, 2, "b"), (6200, [nan] + [1.0] * 7, 1, 1, 2, "b"),
             (6300, [inf] + [1.0] * 7, 1, 1, 2, "b"), (6400, [None] + [1.0] * 7, 1, 1, 2, "b"), (6500, [], 1, 1, 2, "b"),
             (6600, [1.0] * 5, 1, 1, 2, "b"), (6700, [0.0] * 8, 1, 1, 2, "b"), (6800, [30000.5] * 8, 2, 1, 2, "b"),
             (6801, [-0.001] * 8, 2, 1, 2, "b"), (None, [1.0] * 8, 1, 1, 2, "b"), rows[200], rows[200], (300, rows[7][1], 9, 1, 2, "b")]
    return rows


@pytest.mark.parametrize("spread", [0.2, 2.0])
def test_mined_as_by_brute_force(spark, monkeypatch, spread):
    rows = make(1500, spread, 4)
    want = brute(rows)
    assert len(want) > 200
    for name, value in (("CELL_ROWS", 30), ("FIRST_ROWS", 40), ("PART_ROWS", 25), ("ASKED_ROWS", 6)):
        monkeypatch.setattr(mi, name, value)
    assert mined(spark, rows) == want


def test_cells_out_of_reach_are_left_out():
    """The order is that of the bounds, every cell comes once, and near clusters spare cells."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, (10, 8))
    rows = (centres[rng.integers(0, 10, 3000)] + rng.integers(-20, 20, (3000, 8))).astype(np.int64)
    index = mi.Halves(rows, 8)
    cell, square = index.place(rows)
    index.know({c: ((cell == c).sum(), *square[cell == c].max(axis=0)) for c in np.unique(cell).tolist()})
    halves = [rng.standard_normal(len(b)) for b in index.books]
    order = list(index.ordered(halves))
    assert [x[0] for x in order] == sorted((x[0] for x in order), reverse=True)
    assert len({x[1:] for x in order}) == len(order) == index.cells
    spared = 0
    for q in rows[:40]:
        scores = mi.product(q[None, :], rows)[0]
        tenth = np.sort(scores)[-10]
        found, _ = index.visit(q, 0, tenth, float("inf"), float("inf"))
        assert set(cell[scores >= tenth].tolist()) <= set(found)
        spared += len(set(cell.tolist()) - set(found))
        above, _ = index.visit(q, 0, float("-inf"), tenth, float("inf"))
        assert set(cell[scores <= tenth].tolist()) <= set(above)
    assert spared > 0


def test_few_rows(spark):
    assert mined(spark, []) == []
    rows = [(0, [1.0] * 8, 1, 0, 0, ""), (1, [1.0] * 8, 1, 0, 0, ""), (2, [0.5] * 8, 2, 0, 0, ""), (100, [-1.0] * 8, 3, 0, 0, "")]
    assert mined(spark, rows) == brute(rows) and len(brute(rows)) == 0
    rows[0] = (0, [1.0] * 8, 0, 0, 0, "")  # becomes 1
    assert mined(spark, rows) == brute(rows) == [(0, 1, 1, 2, 8 * 65536, 8 * 32768)]
