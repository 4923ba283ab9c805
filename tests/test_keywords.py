import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import keywords, quality, scoring
from vitrine.operators.lookup import first_rule, load_rules

RULES = "keyword string, weight int, priority int"


def brute(title, rules):
    fits = [(p, k.lower(), k, w) for k, w, p in rules if k and title is not None and k.lower() in title.lower()]
    return min(fits)[2:] if fits else (None, None)


@pytest.mark.parametrize("chars", [40, 400, 1_000_000])
def test_first_rule_of_lists_in_many_ranges(spark, chars):
    chance = random.Random(chars)
    word = lambda n: "".join(chance.choice("abcdé ") for _ in range(n))
    rules = [(word(chance.randint(1, 6)), i, chance.randint(0, 900)) for i in range(150)] + [(None, 1, 1), ("", 2, 2), ("ABC", 3, 3), ("abc", 4, 3)]
    rules = list({(k.lower() if k else k, p): (k, w, p) for k, w, p in rules}.values())  # one weight per word and priority
    rows = [(i, word(chance.randint(0, 12)).upper() if i % 2 else word(9)) for i in range(200)] + [(900, None), (901, ""), (5, "abc"), (5, "abc")]
    frame = spark.createDataFrame(rows, "id int, title string").withColumn("lowered", F.lower("title"))
    got = keywords.with_first_rule(frame, spark.createDataFrame(rules, RULES), "lowered", "rule", chars).select("title", "rule.keyword", "rule.weight")
    assert got.count() == len(rows)
    for title, keyword, weight in got.collect():
        assert (keyword, weight) == brute(title, rules), title


def test_a_hundred_thousand_rules(spark):
    rules = spark.range(100_000).selectExpr("concat('word', id, 'x') keyword", "cast(id as int) weight", "cast(id as int) priority")
    rows = spark.createDataFrame([(1, "A WORD59999x and word12x"), (2, "nothing"), (3, "word100000x"), (4, None)], "id int, title string")
    found = first_rule(rows, rules)
    assert {r["id"]: r["weight"] for r in found.collect()} == {1: 12, 2: None, 3: None, 4: None}
    assert found.columns == ["id", "title", "weight"] and found.schema["weight"].dataType.simpleString() == "int"
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan  # titles aren't moved


def test_gate_and_score_take_tables(spark):
    titles = ["Capinha para celular boa", "Mouse gamer sem fio", "Notebook gamer com capinha", "Cabo usb de um metro", "Produto sem nada", None]
    rows = spark.createDataFrame([(i, t, "https://x", 50.0, None, None, None, False) for i, t in enumerate(titles)],
                                 "i int, title string, link string, price double, original_price double, discount_pct double, coupon_code string, free_shipping boolean")
    blocked, value, low = ["gamer", "Capinha"], [("gamer", 9), ("mouse", 5), ("cabo", 2)], ["usb"]
    listed = lambda words: spark.createDataFrame([("a", w, n) for n, w in enumerate(words)], "rule_set string, keyword string, priority int")
    weighted = spark.createDataFrame([("v", k, w, n) for n, (k, w) in enumerate(value)], "rule_set string, keyword string, weight int, priority int")
    seen = lambda df, column: [r[0] for r in df.orderBy("i").select(column).collect()]
    assert seen(quality.quality_gate(rows, blocked=listed(blocked)), "reason") == seen(quality.quality_gate(rows, blocked=blocked), "reason")
    assert seen(quality.quality_gate(rows, blocked=[], poor=listed(["metro"])), "reason") == seen(quality.quality_gate(rows, blocked=[], poor=["metro"]), "reason")
    plain = scoring.score_parts(rows, value_keywords=value, low_value=low, priority_keywords=["boa"], priority_points=4)
    tables = scoring.score_parts(rows, value_keywords=load_rules(weighted, "v"), low_value=listed(low), priority_keywords=listed(["boa"]), priority_points=4)
    assert seen(plain, "parts") == seen(tables, "parts") and plain.columns == tables.columns
    none = listed([]).limit(0)
    assert seen(quality.quality_gate(rows, blocked=none), "reason") == seen(quality.quality_gate(rows, blocked=[]), "reason")
