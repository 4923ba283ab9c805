import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from vitrine.llm import chat_template, quality_gam, simhash


# --- quality ------------------------------------------------------------------------
@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(20, 120)) + "."
        rows.append((i, text if good else " ".join(w + "###" for w in text.split())))
        labels.append((i, int(good)))
    labels += [(0, 1 - labels[0][1]), (5, None), (None, 1), (9999, 0), (7, labels[7][1])]
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels[:600]))


def test_quality_held_out(graded):
    docs, labels, truth = graded
    got = quality_gam.score_documents(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert quality_gam.keep_good(docs, labels).count() == sum(r["score"] >= 0.5 for r in got)


def test_quality_of_hard_rows(hard, none, graded):
    got = quality_gam.score_documents(hard, graded[1])
    assert got.count() == hard.count() and got.where("score is null or held_out is null").count() == 0
    assert quality_gam.score_documents(none, graded[1]).count() == 0
    assert quality_gam.keep_good(hard, graded[1]).columns == hard.columns


def test_quality_without_labels(hard, graded):
    assert {r["score"] for r in quality_gam.score_documents(hard, graded[1].limit(0)).collect()} == {0.5}


def test_pair_tables_find_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.Gam.fit(x, y, pairs=1)
    assert set(model.pairs[0]) == {0, 1} and ((model.score(x) > 0.5) == y).mean() > 0.9


# --- fingerprints -------------------------------------------------------------------
def votes(text):
    """The 64 sums of signed votes, in plain Python."""
    import xxhash
    words = text.lower().split()
    sums = [0.0] * 64
    for word in set(words):
        value, weight = xxhash.xxh3_64_intdigest(word.encode()), 1 + math.log(words.count(word))
        for k in range(64):
            sums[k] += weight if value >> k & 1 else -weight
    return sums


def test_fingerprints_by_counting_votes(spark, hard, hard_rows):
    got = {r["doc_id"]: r["fingerprint"] & (1 << 64) - 1 for r in simhash.fingerprints(hard.where("doc_id <> 8")).collect()}
    clear = 0
    for doc_id, text, *_ in hard_rows:
        if doc_id in got and doc_id != 8 and len(text or "") < 50_000:
            sums = votes(text or "")
            for k, v in enumerate(sums):
                if abs(v) > 1e-3 * (1 + max(map(abs, sums))):  # else rounding may decide
                    assert (got[doc_id] >> k & 1) == (v > 0)
                    clear += 1
            assert any(sums) or got[doc_id] == 0
    assert clear > 500


@pytest.mark.parametrize("radius,blocks,tile", [(0, 2, 9), (3, 5, 2048), (3, 5, 16), (3, 6, 20), (5, 8, 2048)])
def test_counted_search(spark, monkeypatch, radius, blocks, tile):
    """A large group of near values, loose ones, repeats and nulls; groups above the tile are cut once more."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(blocks)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = base + [base[0] ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))) for _ in range(250)]
    values += [base[1] ^ i for i in range(90)] + [0, 1, (1 << 64) - 1]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    index = spark.createDataFrame([(v,) for v in signed + signed[:50] + [None, None]], "fingerprint long")
    got = {r["fingerprint"]: r["near"] for r in simhash.count_within(index, radius, blocks).collect()}
    once = set(signed)
    want = {a: sum(a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius for b in once) for a in once}
    assert got == {a: n for a, n in want.items() if n}


def test_edit_likeness(hard, hard_rows, none):
    words = simhash.Words()
    order = sorted(hard_rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = simhash.edit_likeness(hard).collect()
    assert len(got) == len(order)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    for row, after in zip(order, order[1:] + order[:1]):
        t = row[1] or ""
        mine = [r for r in of[row[0]] if r["n_chars"] == len(t)]
        assert {r["fingerprint"] for r in mine} == {f"{simhash.fingerprint(t, words) & (1 << 64) - 1:016x}"}
        tied = sum(r[0] == row[0] for r in order) > 1 or sum(r[0] == after[0] for r in order) > 1
        if not tied:
            n, u = len(t), after[1] or ""
            edited = t[:n - n // 2] + u[:n // 2]
            r = mine[0]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            a, b, c = (simhash.fingerprint(x, words) & (1 << 64) - 1 for x in (t, edited, u))
            assert r["near_edited"] == 1 - (a ^ b).bit_count() / 64 and r["near_next"] == 1 - (a ^ c).bit_count() / 64
    every = {int(r["fingerprint"], 16) for r in got}
    assert all(r["near"] == sum(0 < (int(r["fingerprint"], 16) ^ f).bit_count() <= 3 for f in every) for r in got)
    assert simhash.edit_likeness(none).count() == 0


def test_a_single_document_follows_itself(spark):
    row = simhash.edit_likeness(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and row["near_next"] == 1


@pytest.mark.parametrize("radius,blocks", [(0, 1), (1, 3), (3, 6), (5, 8)])
def test_block_tables_find_all(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (1, 2, 3, 5, 6)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values] + [None]
    index = spark.createDataFrame([(v,) for v in signed + signed[:5]], "fingerprint long")
    got = {(r[0], r[1]) for r in simhash.within(index, index, radius, blocks).collect()}
    assert got == {(a, b) for a in signed[:-1] for b in signed[:-1] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}


# --- chat -----------------------------------------------------------------------------
def render(source, **env):
    return "".join(t for t, _ in chat_template.compile_template(source)(env))


@pytest.mark.parametrize("source,want", [
    ("a{{ 'b' + 'c' }}d", "abcd"), ("{% if 1 == 2 %}x{% elif a %}y{% else %}z{% endif %}", "y"),
    ("{% for m in l %}{{ loop.index }}{{ m.k | upper }}{% if loop.first %}!{% endif %}{% endfor %}", "1P!2Q"),
    ("{{ l[0].k ~ l[1]['k'] }}", "pq"), ("{{ missing.entry }}|{{ a and 'yes' or 'no' }}", "|yes"),
    ("x {{- 'y' -}} z{# note #}", "xyz"), ("{{ not a }}{{ 'p' in 'pq' }}{{ 7 % 4 - 1 }}", "FalseTrue2"),
    ("{{ a.upper }}", ""), ("{% for x in nothing %}n{% endfor %}", "")])
def test_template(source, want):
    assert render(source, a="t", l=[{"k": "p"}, {"k": "q"}]) == want


@pytest.mark.parametrize("source", ["{% if a %}", "{{ a | exec }}", "{{ f() }}", "{{ a.__class__ }}", "{% for x %}{% endfor %}", "{% set x %}", "{{ a b }}", "{{ }}"])
def test_template_errors(source):
    with pytest.raises(chat_template.TemplateError):
        chat_template.compile_template(source)


def test_constants_are_folded():
    assert chat_template.parse("a{{ 'b' + 'c' | upper }}{% if 'x' == 'x' %}d{% endif %}") in [
        (chat_template.Const("abC"), chat_template.Const("d")), (chat_template.Const("abCd"),)]


@pytest.mark.parametrize("text", ["", "\\", "\\\\<s>", "</s>[INST] ok [/INST]", "<</s>s>", "\\n[INST\\]", "<s</s>>\n"])
def test_escape_can_be_undone(text):
    safe = chat_template.escape(text)
    assert chat_template.unescape(safe) == text and not any(c in safe for c in chat_template.CONTROLS)


@pytest.mark.parametrize("segment", [10, 1_000_000])
def test_conversations(spark, segment):
    rows = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", "yes"), (1, 2, "assistant", "again\\"), (2, 1, "user", None), (2, 0, None, "x"),
            (3, 0, "assistant", ""), (4, 0, "assistant", "z" * 5000), (4, 0, "assistant", "z" * 5000), (None, None, None, None)]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, body string")
    segments = chat_template.format_conversations(chat_template.with_control_case(turns), segment=segment)
    got = {r["conv_id"]: r for r in chat_template.read_back(segments).collect()}
    case = "</s>[INST] ok [/INST]"
    by = {-1: [(0, "user", case), (1, "assistant", case)]}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own = sorted(own, key=str)
        loss = "".join(t for _, role, t in own if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (
            len(own), digest("".join(f"{r}\n{t}\n" for _, r, t in own)), len(loss), digest(loss))
    chars = {r["conv_id"]: r["n"] for r in segments.groupBy("conv_id").agg(F.sum(F.length("body")).alias("n")).collect()}
    assert chars == {c: r["formatted_chars"] for c, r in got.items()}
    body = "".join(r["body"] for r in segments.where("conv_id = -1").orderBy("segment").collect())
    assert len(re.findall("</s>", body)) == 2


def test_conversations_of_nothing(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_template.round_trip(turns).count() == 0
