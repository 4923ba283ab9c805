import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import prose
from vitrine.llm import components, fair_mix, histogram_shard, ngram_join, stable_neighbours
from vitrine.shared import run_folder

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components_of(rows):
    """Per row of (doc_id, text) its set and the number of its group, by comparing all pairs."""
    sets, low = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                low[max(top(i), top(j))] = min(top(i), top(j))
    return sets, [top(i) for i in range(len(rows))]


def classes(rows):
    """(doc_id, text) to [(doc_id, set size, smallest reachable id)]."""
    sets, group = components_of(rows)
    ids = defaultdict(list)
    for g, (doc_id, _) in zip(group, rows):
        ids[g].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted([(r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group)], key=str)


def one_per_group(rows):
    """doc_ids of the rows that stay: the smallest of each group, null last."""
    ids = defaultdict(list)
    for g, (doc_id, _) in zip(components_of(rows)[1], rows):
        ids[g].append(doc_id)
    return [min(v, key=lambda x: (x is None, x or 0)) for v in ids.values()]


# --- n-gram join --------------------------------------------------------------------
def test_join_of_hard_rows(hard, hard_rows, none):
    got = ngram_join.duplicate_classes(hard).collect()
    assert sorted(map(tuple, got), key=str) == classes([(r[0], r[1]) for r in hard_rows])
    assert ngram_join.duplicate_classes(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_join_of_near_copies(spark, seed):
    """Groups of copies edited more and more, chains whose ends don't link, and passages that many texts share."""
    rng = random.Random(seed)
    rows, passage = [], prose(rng, 60)
    for _ in range(6):
        base = prose(rng, rng.randint(12, 150)).split(" ")
        for _ in range(rng.randint(1, 30)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = prose(rng, 1)
            rows.append(" ".join(own))
            if rng.random() < 0.3:
                base = own
    rows += [passage + " " + prose(rng, rng.randint(5, 80)) for _ in range(40)]
    rows += [prose(rng, rng.randint(1, 6)) for _ in range(20)] + ["a b c d e", "A b C d e", "a b c d"]
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.duplicate_classes(docs).collect()), key=str) == classes(list(enumerate(rows)))


def test_join_of_hot_shingles_as_rows(spark, monkeypatch):
    rng = random.Random(4)
    base = prose(rng, 60).split(" ")
    rows = [" ".join(w if rng.random() > 0.04 else "new" for w in base) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for hot in (1, 4):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        assert sorted(map(tuple, ngram_join.duplicate_classes(docs).collect()), key=str) == classes(list(enumerate(rows)))


def test_one_row_of_each_group_stays(spark):
    """Two texts under one id, copies without id, repeated rows; a column named like the row number."""
    rng = random.Random(6)
    a, b, c = (prose(rng, 40) for _ in range(3))
    rows = [(1, a, "a"), (8, a, "gone"), (8, "same id, other text", "c"), (None, a, "gone"), (5, b, "e"), (5, b, "e"), (5, b, "e"),
            (None, c, "g"), (None, c, "g"), (None, c.upper(), "g"), (3, None, "i"), (3, None, "i"), (None, "", "k")]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(parts)
        got = ngram_join.one_of_each(docs)
        assert got.columns == docs.columns
        assert sorted(r["row"] for r in got.collect()) == ["a", "c", "e", "g", "i", "i", "k"]


def test_suffix_bound_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        assert ngram_join.suffix_bound(a, b) <= len(np.setxor1d(a, b))


def test_packed_arrays_come_back():
    rng = np.random.default_rng(0)
    x = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (ngram_join.unpack_sorted(ngram_join.pack_sorted(x)) == x).all()
    assert len(ngram_join.unpack(ngram_join.pack(np.zeros(0, np.uint64)), "<u8")) == 0


def test_contraction(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7), (50, 51), (51, 50), (-3, 100)]
    got = components.contract(spark.createDataFrame(links, "a long, b long"), run_folder(spark, "contract"), "g").collect()
    groups = defaultdict(set)
    for r in got:
        groups[r["group"]].add(r["key"])
    assert sorted(map(sorted, groups.values())) == [[-3, *range(100, 140)], list(range(21)), [50, 51]]


# --- mix ----------------------------------------------------------------------------
def goals(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, free, rest, out = {s: 1 + k % 3 for k, s in enumerate(names)}, set(names), sum(sizes.values()), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > 3 * sizes[s] + 1e-9]
        if not over:
            break
        for s in over:
            out[s] = 3 * sizes[s]
            free.discard(s)
        rest -= sum(out[s] for s in over)
    return out | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}


def check_mix(rows, got):
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = goals(sizes), Counter()
    by_row = Counter((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), sizes[s], s) for d, s, t in rows)
    assert len(got) == len(rows)
    left = defaultdict(list)
    for (d, n, total, s), times in by_row.items():
        left[d, n, total].extend([s] * times)
    for r in got:
        near = [s for s in left[r["doc_id"], r["size"], r["source_size"]] if abs(want[s] - r["target"]) < 1e-6 * max(1, want[s])]
        assert near and 0 <= r["taken"] <= 3 * r["size"]
        left[r["doc_id"], r["size"], r["source_size"]].remove(near[0])
        taken[near[0]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(1, want[s] / 1000) + 1 for s in want)  # a quantum, and what rounding leaves
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 1


def test_mix_of_hard_rows(hard, hard_rows, none):
    got = fair_mix.taken(hard)
    check_mix([(r[0], r[3], r[1]) for r in hard_rows], got.collect())
    again = fair_mix.taken(hard.repartition(3))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert fair_mix.taken(none).count() == 0 and fair_mix.mixed_documents(none).count() == 0


def test_targets_at_their_limits(spark):
    rng = random.Random(2)
    rows = [(i, s, prose(rng, n)) for i, (s, n) in enumerate(
        [("a", 900), ("a", 50), ("b", 3), ("c", 40), ("c", 2), ("d", 1), ("é", 10), (None, 30), ("f", 0)])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    check_mix(rows, fair_mix.taken(docs).collect())
    folder = run_folder(spark, "mix")
    line = fair_mix.mix_order(fair_mix.sized(docs, folder), folder).orderBy(*fair_mix.ORDER).collect()
    assert sum(r["served"] for r in line) == sum(len(t.split()) for _, _, t in rows)
    behind = fair_mix.queued(fair_mix.sized(docs, run_folder(spark, "mix"))).collect()
    assert min(r["finish"] for r in behind) == line[0]["finish"] and max(r["finish"] for r in behind) >= line[-1]["finish"]
    assert all(r["served"] == min(r["size"], max(1, int(r["target"] // 1000))) or r["quantum"] for r in line[:-1] if r["size"] <= 1)
    mixed = Counter(r["doc_id"] for r in fair_mix.mixed_documents(docs).collect())
    assert max(mixed.values()) == 3 and fair_mix.mixed_documents(docs).columns == docs.columns


# --- shards ---------------------------------------------------------------------------
def check_shards(rows, got, shards, slack):
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == sorted(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows if d is not None)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    mean = sum(r["size"] for r in got) / shards
    sizes = [sum(r["size"] for r in by[k]) for k in range(shards)]
    assert all(abs(s - mean) <= slack for s in sizes), sizes


def test_shards_of_hard_rows(hard, hard_rows, none):
    got = histogram_shard.digests(hard).collect()
    assert len(got) == len(hard_rows)
    check_shards([(r[0], r[1]) for r in hard_rows], got, 40, max(r["size"] for r in got))
    assert histogram_shard.digests(none).count() == 0


def shards_of_texts(rows, got):
    text, out = {}, defaultdict(set)
    for d, t in rows:
        text[d] = t or ""
    for r in got:
        out[text[r["doc_id"]]].add(r["shard"])
    return out


def test_groups_below_a_mean_shard_stay_whole(spark):
    """Groups from tiny to just below a mean shard, at whatever place of the order; larger ones are divided."""
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(20, 400)) for _ in range(60)]
    rows = [(i, texts[min(int(rng.expovariate(0.08)), 59)]) for i in range(700)] + [(1000 + i, None if i % 2 else "") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shards in (3, 10, 40):
        got = histogram_shard.digests(docs, shards).collect()
        mean = sum(r["size"] for r in got) / shards
        group = Counter()
        for _, t in rows:
            group[t or ""] += len((t or "").encode()) + 16
        for t, of in shards_of_texts(rows, got).items():
            assert len(of) == 1 or group[t] >= mean, (shards, group[t], mean)
        check_shards(rows, got, shards, max([g for g in group.values() if g < mean] + [2000]) + 2000)


def test_shards_with_a_hot_text(spark):
    rng = random.Random(1)
    rows = [(i, "the same text again" if i % 3 == 0 else prose(rng, rng.randint(1, 60))) for i in range(900)] + [(5, "tie")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = histogram_shard.digests(docs, 7).collect()
    check_shards(rows, got, 7, max(r["size"] for r in got))


# --- neighbours -------------------------------------------------------------------------
def check_neighbours(rows, got, every=100, k=10):
    use = {}
    for i, v in rows:
        ok = i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)
        if ok:
            use.setdefault(i, []).append(np.array(v, float))
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    assert set(found) == {i for i in use if i % every == 0 and len(use) > 1}
    for q, own in found.items():
        want = sorted((min(float(np.sqrt(((v - use[q][0]) ** 2).sum())) for v in vs), i) for i, vs in use.items() if i != q)
        assert [r for r, _, _ in own] == list(range(1, min(k, len(want)) + 1))
        score = {i: d for d, i in want}
        assert all(abs(s - score[i]) < 1e-9 for _, i, s in own)
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        hits += len({i for _, i in want[:k]} & {i for _, i, _ in own})
        total += min(k, len(want))
    return hits / max(1, total)


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(8) + 3 * (i % 7)).tolist()) for i in range(2500)]
    rows += [(3000 + i, rows[100][1]) for i in range(40)]  # one vector many times: ties go to the smaller id
    nan = float("nan")
    rows += [(4000, None), (4100, [0.0] * 8), (4200, [nan] + [1.0] * 7), (4300, [float("inf")] + [1.0] * 7), (4400, []), (4500, [1.0] * 5),
             (4600, [None] + [1.0] * 7), (None, [1.0] * 8), (200, rows[200][1]), (7, rows[7][1])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cell int, part int")
    assert check_neighbours(rows, stable_neighbours.neighbours(table).collect()) >= 0.9
    monkeypatch.setattr(stable_neighbours, "CELL_ROWS", 100)
    monkeypatch.setattr(stable_neighbours, "PART_ROWS", 30)
    assert check_neighbours(rows, stable_neighbours.neighbours(table).collect()) >= 0.9


def test_few_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    rows = [(0, [1.0] * 8), (1, [2.0] * 8), (2, [0.0] * 8)]
    got = stable_neighbours.neighbours(spark.createDataFrame(rows, kind)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"] ** 2, 9)) for r in got] == [(0, 1, 1, 8.0)]
    assert stable_neighbours.neighbours(spark.createDataFrame([], kind)).count() == 0


def test_chi_square_quantile():
    assert abs(stable_neighbours.stop_ratio(0.95, 8) - 15.507) < 1e-3 and abs(stable_neighbours.stop_ratio(0.5, 2) - 1.386) < 1e-3


# --- pipeline ---------------------------------------------------------------------------
def test_pipeline(spark, tmp_path, hard, hard_rows):
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert len(corpus_pipeline.STAGES) == 4
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.count() == len(hard_rows)  # nothing is known, nothing is rejected
    one = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    stay = one_per_group([(r[0], r[1]) for r in hard_rows])
    assert len(stay) < len(hard_rows) and sorted(str(r["doc_id"]) for r in one.collect()) == sorted(map(str, stay))
    assert one.columns == docs.columns
    mixed = corpus_pipeline.mix(spark, one, str(tmp_path))
    assert mixed.columns == docs.columns and max(Counter(map(str, mixed.collect())).values()) <= 3 * 3
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == mixed.count()


def test_pipeline_of_nothing(spark, tmp_path, none):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
