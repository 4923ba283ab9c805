import random
from difflib import SequenceMatcher

import pytest

from vitrine.operators import titles

WORDS = "mouse teclado gamer sem fio preto branco monitor curvo hub usb cabo fone ação 你好 kit".split()


def edited(chance, text, edits):
    for _ in range(edits):
        at = chance.randrange(len(text) + 1)
        text = chance.choice([text[:at] + chance.choice("aeox ") + text[at:], text[:at] + text[at + 1:], text[at:] + text[:at] if chance.random() < 0.1 else text])
    return text


def make(seed, count=160):
    chance = random.Random(seed)
    base = [" ".join(chance.choice(WORDS) for _ in range(chance.randint(1, 14))) for _ in range(count)]
    left = base + ["a" * n for n in range(1, 40, 4)] + ["", "x", "xy", "ab" * 20, "é" * 60]
    right = [edited(chance, chance.choice(left), chance.randint(0, 12)) for _ in range(count)]
    right += ["a" * n for n in range(2, 44, 3)] + ["", "y", "ba" * 20, "abc" * 14]
    return left, right


def likeness(a, b):
    return SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("threshold", [0.85, 0.6, 1.0])
def test_pairs_are_those_of_all_comparisons(spark, monkeypatch, threshold):
    monkeypatch.setattr(titles, "POSTINGS", 7)  # common grams are dealt out
    left, right = make(int(threshold * 100))
    frame = lambda rows: spark.createDataFrame([(r, 1) for r in rows + rows[:9] + [None]], "norm string, id int")
    got = titles.similar_pairs(frame(left), frame(right), threshold).collect()
    want = {(a, b): likeness(a, b) for a in set(left) for b in set(right) if a != b and likeness(a, b) >= threshold}
    assert len(got) == len(want) and {(r["norm"], r["other_norm"]): r["ratio"] for r in got} == want
    assert threshold == 1.0 or len(want) > 30


def test_common_grams_is_a_lower_bound():
    """Edited titles keep at least as many grams as the bound says."""
    from collections import Counter
    chance, checked = random.Random(5), 0
    for _ in range(4000):
        a = "".join(chance.choice("abcdefgh ") for _ in range(chance.randint(1, 60)))
        b = edited(chance, a, chance.randint(0, 8))
        ratio = likeness(a, b)
        for threshold in (0.6, 0.85):
            if ratio >= threshold:
                for q in (1, 2, 3):
                    grams = lambda t: Counter(t[i:i + q] for i in range(len(t) - q + 1))
                    assert (grams(a) & grams(b)).total() >= titles.common_grams(len(a), len(b), q, threshold)
                    checked += 1
    assert checked > 3000


def test_unlike_known(spark):
    known = spark.createDataFrame([("Mouse Gamer Sem Fio Preto!", 1), (None, 2), ("", 3)], "title string, k int")
    offers = spark.createDataFrame(
        [(1, "mouse gamer sem fio preto"), (2, "Mouse gamer sem fios preto"), (3, "Teclado mecânico branco"), (4, None), (5, "99"), (6, "Teclado mecânico branco")],
        "id int, title string")
    assert sorted(r["id"] for r in titles.unlike_known(offers, known).collect()) == [3, 4, 6]
    nothing = known.filter("k > 9")
    assert titles.unlike_known(offers, nothing).count() == 6 and titles.unlike_known(offers.filter("id > 9"), known).count() == 0


def test_titles_with_a_long_run_in_common_meet_in_few_pairs(spark):
    """The run is most of a title's 3-grams, so every title met every other on it."""
    all_titles = [chr(0x4E00 + n // 4) * 20 + "x" * (22 + n * 3 % 8) for n in range(1200)]
    rows = lambda part: spark.createDataFrame([(t,) for t in sorted(set(part))], "norm string").selectExpr("norm", "xxhash64(norm) id")
    new, known = rows(all_titles[::2]), rows(all_titles[1::2])
    plan, frequencies = titles._cheapest(new, known, 0.85)
    assert titles._meetings(new, known, plan, frequencies) < 100 * len(all_titles)
    got = {(r.norm, r.other_norm) for r in titles.similar_pairs(new, known, 0.85).collect()}
    want = {(a, b) for a in set(all_titles[::2]) for b in set(all_titles[1::2]) if a[0] == b[0] and a != b and SequenceMatcher(None, a, b).ratio() >= 0.85}
    assert got == want and got
