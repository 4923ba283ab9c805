import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from vitrine.llm import conversation_trie as ct

KIND = "conv_id long, turn long, role string, text string, k int, n long, place int"


def brute(rows, family):
    """Every node by Python's own dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    built = own
    if family:
        built = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            root = c - (c % 20 if c >= 0 else -(-c % 20))
            built[c] = own.get(root, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
            leaves[p[:d]] += children[p] == 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items())


def seen(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def make(seed):
    rng = random.Random(seed)
    turns = [(rng.choice(["user", "assistant", None]), rng.choice([None, "", "a b", "x\ty  z", "word " * 300, "é 你好"])) for _ in range(6)]
    rows = []
    for c in [*range(0, 70), 400, -1, -20, -25, None]:
        base = [turns[rng.randrange(2)] for _ in range(rng.randint(1, 9))]
        for i, (role, text) in enumerate(base):
            if rng.random() < 0.1:
                role, text = rng.choice(turns)
            rows.append((c, rng.choice([i, i, i, None, 3]), role, text, 1, 2, 3))
    rows += [(900 + i, j, "user", f"same {j}", 0, 0, 0) for i in range(40) for j in range(5)]
    rows += [(960, j // 2, "user", "again", 0, 0, 0) for j in range(37)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [1, 4])
def test_trie_of_hard_rows(spark, size, monkeypatch):
    rows = make(size)
    df = spark.createDataFrame(rows, KIND)
    monkeypatch.setattr(ct, "IDS_PER_PIECE", 3)
    assert seen(ct.conversation_nodes(df, size)) == brute(rows, False)
    monkeypatch.setattr(ct, "HOT", 5)
    assert seen(ct.family_nodes(df.repartition(3), size)) == brute(rows, True)


def test_turnless_and_empty(spark):
    empty = spark.createDataFrame([], KIND)
    assert ct.conversation_nodes(empty).count() == 0 and ct.family_nodes(empty).count() == 0
    short = next(c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)  # takes three turns of nothing
    rows = [(short, 0, "user", "hi", 0, 0, 0)]
    assert seen(ct.family_nodes(spark.createDataFrame(rows, KIND))) == brute(rows, True)


def test_sql_says_the_same(spark):
    rows = [r for r in make(9) if r[0] is None or r[0] >= 0]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
        got = db.execute(ct.FAMILY_SQL).fetchall()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == brute(rows, True)
