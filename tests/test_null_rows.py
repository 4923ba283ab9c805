"""Rows without a link, title, key, time or batch: none is lost, none blocks another by chance."""
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from vitrine.operators import counts, dedup, history
from vitrine.operators.greedy import first_wins
from vitrine.sources.embedded import find_offer_list

START = datetime(2024, 5, 1, 1)


@pytest.mark.parametrize("chunk", [1, 5_000])
def test_first_wins_without_links_and_titles(spark, chunk):
    rows = [(1, None, "mouse gamer"), (2, None, "monitor curvo"), (3, None, None), (4, "https://x/a", None), (5, "https://x/a", "cabo usb"),
            (6, "https://x/b", "teclado branco"), (7, "https://x/b", "hub fone"), (8, None, "mouse gamer")]
    got = first_wins(spark.createDataFrame(rows, "id int, link string, title string"), ["id"], chunk_rows=chunk)
    assert {r.id: r.verdict for r in got.collect()} == {
        1: "accepted", 2: "accepted", 3: "accepted", 4: "similar_title", 5: "accepted", 6: "accepted", 7: "same_link", 8: "similar_title"}


def test_replay_accepts_rows_without_key(spark):
    rows = spark.createDataFrame([(None, i, START + timedelta(seconds=i)) for i in range(12)] + [("k", 20, START), ("k", 21, START)],
                                 "key string, i int, at timestamp")
    assert sorted(r["i"] for r in dedup.replay_ttl(rows, "key", "at", ["at", "i"], ttl_seconds=5).collect()) == [*range(12), 20]


def test_price_series_keeps_every_row(spark):
    rows = [("l", Decimal(5), START), (None, Decimal(7), START), (None, Decimal(6), None), ("l", Decimal(4), None), (None, Decimal(8), START + timedelta(days=40))]
    got = history.price_series(spark.createDataFrame(rows, "link string, price decimal(12,2), recorded_at timestamp"))
    assert sorted((str(r.link), int(r.price), int(r.lowest_so_far), r.previous_price and int(r.previous_price)) for r in got.collect()) == sorted(
        [("l", 4, 4, None), ("l", 5, 4, 4), ("None", 6, 6, None), ("None", 7, 6, 6), ("None", 8, 6, 7)], key=str)


def test_running_totals_with_a_null_batch(spark):
    rows = spark.createDataFrame([(None, 5), (1, 2), (9, 3)], "b int, c int")
    got = counts.running_totals(rows, "b", ["c"], block=4).collect()
    assert {r.b: r.total_c for r in got} == {None: 5, 1: 7, 9: 10}


def test_the_first_filled_child_decides():
    offers = [{"offerId": 1, "title": "a"}]
    tree = {"props": {"pageProps": {"serverOffers": {"offers": {"count": 3}, "list": offers}}}}
    assert find_offer_list(tree) is None  # offers is filled, and no list
    tree["props"]["pageProps"]["serverOffers"]["offers"] = {}
    assert find_offer_list(tree) == offers
