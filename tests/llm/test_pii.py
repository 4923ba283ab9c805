import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from vitrine.llm import crf_pii as pii

NAIVE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def naive(text):
    out = []
    for kind, pattern in NAIVE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            n = len(digits)
            even = [int(d) for d in digits[-2::-2]]
            luhn = (sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 16 <= n <= 19 and luhn, "phone": 8 <= n <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


@pytest.fixture(scope="session")
def field():
    return pii.fit(pii.labelled_rows())


def test_base_spans_as_the_patterns_say():
    rng = random.Random(2)
    pieces = ["a", "b@", "@", ".", "c.d", "-", "1", "22", "255", "256", ".3", "+", " ", "(", ")", "é", "4111111111111111", "4111 1111 1111 1111",
              "+1 555 0100", "x@y.z", "1.2.3.4", "000001.2.3.4", "\n", "%_"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert sorted(pii.base_spans(text)) == sorted(naive(text)), text


def test_long_texts_take_linear_time():
    start = time.time()
    for text in ("x" * 400_000 + "@a.b", "1" * 400_000, "1." * 200_000, "@" * 400_000, "a@" * 200_000, "+1" + " " * 400_000, "a@b" * 150_000, "1 " * 20_000):
        pii.find_batch(pii.Field(18), [text])
    assert time.time() - start < 60


def test_decoding_finds_the_best_path():
    rng = np.random.default_rng(0)
    field = pii.Field(1, 3)
    field.move, field.begin = rng.standard_normal((3, 3)), rng.standard_normal(3)
    scores, lengths = rng.standard_normal((6, 5, 3)), np.array([1, 2, 3, 4, 5, 5])
    got = field.viterbi(scores, lengths)

    def value(k, path):
        return field.begin[path[0]] + sum(scores[k, i, y] for i, y in enumerate(path)) + sum(field.move[a, b] for a, b in zip(path, path[1:]))

    for k, n in enumerate(lengths):
        assert tuple(got[k, :n]) == max(itertools.product(range(3), repeat=int(n)), key=lambda p: value(k, p))
    gold = np.where(np.arange(5) < lengths[:, None], rng.integers(0, 3, (6, 5)), -1)
    total, emit, move, begin = field.gradient(scores, gold)
    every = sum(value(k, tuple(gold[k, :n])) - np.log(sum(np.exp(value(k, p)) for p in itertools.product(range(3), repeat=int(n))))
                for k, n in enumerate(lengths))
    assert abs(total - every) < 1e-9
    for weights, slope in ((scores, emit), (field.move, move), (field.begin, begin)):
        at = np.unravel_index(np.argmax(np.abs(slope)), slope.shape)
        weights[at] += 1e-5
        assert abs((field.gradient(scores, gold)[0] - total) / 1e-5 - slope[at]) < 1e-3
        weights[at] -= 1e-5


def test_held_out_sentences(field):
    rows = pii.labelled_rows(800, seed=77)
    found = pii.find_batch(field, [t for t, _ in rows])
    want = hit = wrong = 0
    for (text, spans), (base, added) in zip(rows, found):
        got = set(base) | set(added)
        want, hit = want + len(spans), hit + sum(tuple(s) in got for s in spans)
        wrong += sum(not any(a[1] < e and s < a[2] for _, s, e in spans) for a in added)
    assert hit >= 0.9 * want and wrong <= 0.01 * len(rows)


def test_sequences_keep_what_is_near_a_trigger():
    text = "word " * 50 + "anna at host dot com " + "word " * 50 + "5" + "x" * 100
    cuts = list(pii.sequences(text))
    assert len(cuts) == 2 and "anna at host dot com" in text[slice(*cuts[0])] and text[slice(*cuts[1])].rstrip().endswith("word")
    assert list(pii.sequences("no such thing")) == []


def test_hard_rows(hard, hard_rows, none, spark, field):
    got = pii.find(hard, field)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    rows = [(1, "anna.b (at) host (dot) com or x@y.zz, 10.0.0.1; call (555) 010-4477 now"), (None, None), (2, ""), (2, ""),
            (3, "bob.33@mail1.example.com " * 2 + "4111 1111 1111 1111 +1 (743) 555-3824")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as n_email")
    seen = {str(r["doc_id"]): r for r in pii.find(table, field).collect()}
    assert pii.find(table, field).count() == 5 and pii.find(none, field).count() == 0
    assert seen["1"]["spans"] == "email:0:26,email:30:36,ip:38:46,phone:53:67" and seen["1"]["n_email"] == 1 and seen["1"]["n_added"] == 2
    assert seen["None"]["spans"] == "" and seen["2"]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (seen["3"]["n_email"], seen["3"]["n_card"], seen["3"]["n_phone"], seen["3"]["n_added"]) == (2, 1, 1, 0)
    want = sorted(str((d, hashlib.sha256(pii.joined(naive(t or "")).encode()).hexdigest())) for d, t, *_ in hard_rows)
    assert sorted(str((r["doc_id"], r["base_sha256"])) for r in got.collect()) == want


def test_table_of_labels(spark):
    rows = [("call x1 now", [("phone", 5, 7)]), (None, None), ("nothing", None), ("", [])]
    table = spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:int,end:int>>")
    assert pii.fit_table(table).emit.shape[2] == 9
    assert pii.fit_table(table.limit(0)).decode(pii.Tokens()).sum() == 0


def test_a_span_longer_than_the_reach_of_its_trigger_is_whole():
    field = pii.fit(pii.labelled_rows())
    local = "_".join("alpha bravo carol delta eagle fancy grape hotel india".split())
    text = f"please write to {local} at example dot com or call "
    whole = [("email", text.find(local), text.find(" or call"))]
    assert pii.find_batch(field, [text, "", text * 3])[0] == ([], whole)
    assert len(local) > pii.REACH


def test_a_span_without_any_trigger_is_found(field):
    text = "please write to anna_lee at example.com today"
    assert list(pii.sequences(text)) == []
    assert pii.find_batch(field, ["", text, "bob at mail.org", " \n", text])[1:3] == [([], [("email", 16, 39)]), ([], [("email", 0, 15)])]


def test_labels_are_those_of_the_best_path_of_the_whole_text(field):
    rng = np.random.default_rng(3)
    texts = [" ".join(t for t, _ in pii.labelled_rows(12, seed=s)) for s in range(30)] + ["", " \n ", "a", "5", "x at y.z", "word " * 500]
    wild = pii.Field(18)
    wild.emit, wild.move, wild.begin = rng.standard_normal(wild.emit.shape), rng.standard_normal((9, 9)), rng.standard_normal(9)
    wild.emit[:, :, 0] += 0.7
    for some in (field, wild):
        tokens = pii.Tokens()
        for text in texts:
            tokens.add(text)
        got, scores = some.decode(tokens), some.scores(pii.places_of(tokens.codes()))
        assert [b - a for a, b in tokens.bounds] == [len(pii.token_spans(t)) for t in texts]
        for a, b in tokens.bounds:
            if b > a:
                assert (got[a:b] == some.viterbi(scores[None, a:b], np.array([b - a]))[0]).all()
        assert got.any()
