import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from vitrine.operators import counts, history, lookup, render, tiers
from vitrine.plans import reports
from vitrine.schemas import COUPONS


def test_until_enough_equals_the_loop(spark):
    chance = random.Random(5)
    rows = [(g, s, n) for g in "abc" for s in range(5) for n in range(chance.randint(0, 6))]
    want = []
    for group in "abc":
        have = 0
        for stage in range(5):
            mine = [r for r in rows if r[:2] == (group, stage)]
            if have < 7:
                want += mine
                have += len(mine)
    frame = spark.createDataFrame(rows, "g string, s int, n int")
    assert sorted(map(tuple, tiers.until_enough(frame, ["g"], ["s"], 7, most=7).collect())) == sorted(want)


def test_best_coupon_equals_the_loop(spark):
    chance = random.Random(9)
    coupons = [("s", f"C{n}", Decimal(chance.choice((0, 10, 20, 30, 40))), Decimal(chance.randint(0, 5)), n) for n in range(12)]
    offers = [(n, "s", Decimal(n) if n else None, "OWN" if n % 5 == 0 else "") for n in range(60)]
    ranked = sorted(coupons, key=lambda c: -c[3])
    want = {}
    for number, _, price, own in offers:
        fits = [c[1] for c in ranked if price is not None and price >= c[2] > 0]
        want[number] = own or (fits[0] if fits else own)
    frame = spark.createDataFrame(offers, "id int, store string, price decimal(12,2), coupon_code string")
    got = lookup.apply_best_coupon(frame, spark.createDataFrame(coupons, COUPONS))
    assert {r.id: r.coupon_code for r in got.collect()} == want
    assert got.columns[-1] == "coupon_code" and got.count() == 60


def test_price_series_of_a_hot_link_uses_many_ranges(spark):
    start, chance = datetime(2024, 1, 1), random.Random(3)
    rows = [("hot" if n % 3 else f"l{n % 40}", Decimal(chance.randint(10, 99)) if n % 17 else None, start + timedelta(minutes=n)) for n in range(600)]
    frame = spark.createDataFrame(rows, "link string, price decimal(12,2), recorded_at timestamp").repartition(3)
    got = {(r.link, r.recorded_at): (r.lowest_so_far, r.previous_price) for r in history.price_series(frame, parts=9).collect()}
    low, last, want = {}, {}, {}
    for link, price, at in rows:
        low[link] = min((p for p in (low.get(link), price) if p is not None), default=None)
        want[link, at] = (low[link], last.get(link))
        last[link] = price
    assert got == want
    dealt = frame.repartitionByRange(9, "link", "recorded_at").withColumn("part", F.spark_partition_id())
    assert dealt.filter("link = 'hot'").select("part").distinct().count() >= 5


def test_price_series_with_slices(spark):
    start, chance = datetime(2024, 1, 1), random.Random(2)
    rows = [("l", Decimal(chance.randint(10, 99)), start + timedelta(days=3 * n)) for n in range(60)]
    frame = spark.createDataFrame(rows, "link string, price decimal(12,2), recorded_at timestamp")
    got = history.price_series(frame, parts=5).orderBy("recorded_at").collect()
    prices = [r[1] for r in rows]
    assert [r.lowest_so_far for r in got] == [min(prices[:n + 1]) for n in range(60)]
    assert [r.previous_price for r in got] == [None, *prices[:-1]]


def test_running_totals_over_blocks(spark):
    frame = spark.createDataFrame([(n, n % 7) for n in range(50)], "b int, c int")
    got = counts.running_totals(frame, "b", ["c"], block=8).orderBy("b").collect()
    assert [r.total_c for r in got] == [sum(n % 7 for n in range(m + 1)) for m in range(50)]


def test_sent_table_is_idempotent_and_purged(spark, tmp_path):
    path = str(tmp_path / "sent")
    rows = spark.createDataFrame(
        [(f"https://x/{n}", "t", "amazon", 10.0, 20.0, None, "", 50.0, datetime(2024, 1, 1 + n, 12)) for n in range(3)],
        "link string, title string, store string, price double, original_price double, discount_pct double, category string, score double, at timestamp")
    batch = history.as_sent(rows, F.col("at"), F.lit(1))
    for _ in range(2):
        history.append_batch(batch, path, ["sent_date", "batch_id"])
    history.append_batch(history.as_sent(rows.limit(1).withColumn("at", F.col("at") - F.expr("interval 6 hours")), F.col("at"), F.lit(2)), path, ["sent_date", "batch_id"])
    sent = history.read_sent(spark, path)
    assert sent.count() == 4 and sent.filter("discount_pct = 50.0").count() == 4
    assert history.insert_if_absent(batch, sent, ["sent_at"]).count() == 0
    history.purge_before(spark, path, datetime(2024, 1, 1, 10))
    assert history.read_sent(spark, path).count() == 3
    history.purge_before(spark, path, datetime(2024, 1, 3))
    assert [r.link for r in history.read_sent(spark, path).collect()] == ["https://x/2"]
    assert history.read_sent(spark, str(tmp_path / "none")).count() == 0


def test_reports(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "source string")
    runs = spark.createDataFrame(
        [("a", datetime(2024, 1, 2), 1.0, 5, 1, 0, "ok"), ("b", datetime(2024, 1, 2), 1.0, 5, 1, 1, "error"),
         ("a", datetime(2023, 1, 1), 1.0, 5, 1, 9, "error")],
        "source string, run_at timestamp, duration_secs double, items_found long, items_sent long, errors long, status string")
    got = reports.source_health(names("a", "b", "c"), runs, F.lit("2024-01-02 12:00:00").cast("timestamp"))
    assert {r.source: r.health for r in got.collect()} == {"a": "ok", "b": "fail", "c": "no data"}
    assert [r.source for r in reports.disabled_sources(names("c", "a", "b"), names("b")).collect()] == ["a", "c"]


def test_messages(spark):
    rows = spark.createDataFrame(
        [(1, "Mouse_X", "https://l", "pelando", 399.0, 549.0, None, "SHARK20", True, {"origin_store": "C&A"}, "https://x/a.jpg"),
         (2, "Oferta", "https://l", "pelando", None, None, 70.0, None, False, {"origin_store": "Loja Desconhecida XYZ"}, ""),
         (3, "Oferta", "https://l", "kabum", 58.49, None, None, "", False, {"origin_store": "Amazon"}, "")],
        "i int, title string, link string, store string, price double, original_price double, discount_pct double, coupon_code string, free_shipping boolean, extra map<string,string>, image_url string")
    money = rows.withColumn("price", F.col("price").cast("decimal(12,2)")).withColumn("original_price", F.col("original_price").cast("decimal(12,2)"))
    full, bare, simple = [r.m for r in money.orderBy("i").select(render.offer_message().alias("m")).collect()]
    for part in ("Mouse\\_X", "\U0001f455 *Loja:* C&A", "~R$ 549,00~", "`R$ 399,00` à vista  *(-27%)*", "`R$ 150,00`", "Frete Grátis", "CUPOM DE DESCONTO", "`SHARK20`"):
        assert part in full
    assert "\U0001f3ea *Loja:* Loja Desconhecida XYZ" in bare and "R$" not in bare and "CUPOM" not in bare
    assert "KaBuM!" in simple and "*Preço:* `R$ 58,49`" in simple and "Economize" not in simple
    assert [r.mode for r in render.publish_queue(money.orderBy("i")).collect()] == ["photo", "text", "text"]
    assert "*CUPOM C&A!*" in money.filter("i = 1").select(render.coupon_message()).first()[0]
