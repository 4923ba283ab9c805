import json
from decimal import Decimal

from pyspark.sql import functions as F

from vitrine.functions import text
from vitrine.functions.html import attr_like, cls, every, has, page_nodes, select_all, tag, text_of
from vitrine.sources import cards, collect, embedded, json_api


def one(frame):
    rows = frame.orderBy("pos").collect()
    assert len(rows) == 1
    return rows[0]


def test_search_item(page):
    item = {"id": "MLB123456", "title": "Notebook Lenovo IdeaPad 3 Ryzen 5", "permalink": "https://m/notebook/MLB123456?utm_source=g",
            "price": 2899.0, "original_price": 3499.0, "thumbnail": "https://h/D_NQ_123-I.jpg", "shipping": {"free_shipping": True}}
    got = one(json_api.search(page(json.dumps({"results": [item, {**item, "original_price": 2900.0}]}))))
    assert (got.price, got.original_price, got.free_shipping) == (Decimal("2899.00"), Decimal("3499.00"), True)
    assert got.image_url.endswith("-O.jpg") and got.link == "https://m/notebook/MLB123456"


def test_scaled_item(page):
    item = {"name": "Fone de ouvido bom", "itemid": 5, "shopid": 6, "price": 12345000000, "price_before_discount": 100}
    body = {"data": {"items": [item, {**item, "price": 0}, {**item, "shopid": None}]}}
    got = one(json_api.wrapped(page(json.dumps(body))))
    assert (got.price, got.original_price, got.link, got.tier) == (Decimal("123450.00"), None, "https://shopee.com.br/product/6/5", 0)


def test_malformed_answers_give_no_rows(page):
    raw = page("{bad", "kabum", "json").unionByName(page("[1,2]", "kabum", "json")).unionByName(page('{"data":[{"id":1}]}', "kabum", "json"))
    assert json_api.catalog(raw).filter("ok").count() == 0
    assert [(r.payloads, r.errors) for r in collect.payload_errors(raw).collect()] == [(3, 1)]


def board(state):
    return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(state)}</script>'


def test_board_state(page):
    offer = {"offerId": "1", "offerTitle": "Teclado Mecânico Gamer", "offerPrice": 499.0, "offerOldPrice": 699.0, "storeName": "KaBuM!",
             "offerAffiliateUrl": "https://www.promobit.com.br/r/1", "offerLink": "https://kabum.com.br/x?utm_source=1&a=2",
             "offerCoupon": " PROMO30 ", "offerPhoto": {"url": "/p.jpg"}}
    got = one(embedded.board_state(page(board({"props": {"pageProps": {"serverOffers": {"offers": [offer]}}}}))))
    assert (got.link, got.coupon_code, got.extra["origin_store"]) == ("https://kabum.com.br/x?a=2", "PROMO30", "KaBuM!")
    assert (got.price, got.original_price, got.discount_pct) == (Decimal("499.00"), Decimal("699.00"), Decimal("28.6"))
    # known place with a wrapping object; unknown place; too deep; a list of one is no offer list
    inner = embedded.board_state(page(board({"props": {"pageProps": {"serverFeaturedOffers": {"list": [offer]}}}})))
    assert inner.count() == 1
    assert embedded.board_state(page(board({"a": {"b": [offer, {**offer, "offerId": "2"}]}}))).count() == 2
    deep = [offer, offer]
    for _ in range(9):
        deep = {"x": deep}
    assert embedded.board_state(page(board(deep))).count() == 0
    assert embedded.board_state(page(board({"a": [offer]}))).count() == 0


SEGMENT = ('"id":[0,"af4a43c9-aa37-4e12-921f-cf1ae5c79f6e"],"slug":[0,"bermuda-1d1a"],"title":[0,"Bermuda Reta de Sarja - verde militar"],'
           '"temperature":[0,31],"date":[0,"11 min"],"price":[0,58.49],"discountPercentage":[0,null],"freeShipping":[0,null],'
           '"status":[0,"active"],"store":[0,{"id":[0,"445"],"name":[0,"C&A"],"slug":[0,"cea"]}],"imageUrl":[0,"x/image.jpg"],'
           '"kind":[0,"promotion"],"sourceUrl":[0,"https://www.cea.com.br/p?ref=1"]')


def test_segments(page):
    got = one(embedded.component_text(page("text " + SEGMENT)))
    assert (got.price, got.discount_pct, got.category, got.free_shipping) == (Decimal("58.49"), None, "promotion", False)
    assert (got.extra["origin_store"], got.link, got.image_url) == ("C&A", "https://www.cea.com.br/p", "https://media.pelando.com.br/x/image.jpg")
    # the last segment is cut, an earlier one is not
    padded = SEGMENT.replace('"kind"', "z" * 6000 + '"kind"')
    assert embedded.component_text(page(padded)).count() == 0
    assert embedded.component_text(page(padded + SEGMENT.replace("af4", "bf4"))).count() == 2
    assert embedded.component_text(page(SEGMENT.replace("active", "expired"))).count() == 0


def test_enclosing_objects():
    text = '} {"a":{"b":1},"productTitle":"x"} {"c":[{"productTitle":"y"}],"d":{}} "productTitle" {"productTitle":'
    assert embedded.enclosing_objects(text, '"productTitle"') == ['{"a":{"b":1},"productTitle":"x"}', '{"productTitle":"y"}']
    assert embedded.enclosing_objects(None, "x") == []


def test_script_pairs_limit(page):
    pair = lambda n: f'"asin":"B{n:09d}","displayPrice":"R$ {n},00" '
    script = lambda numbers: "<script>" + "".join(map(pair, numbers)) + "</script>"
    body = script(range(1, 41)) + script(range(50, 60)) + script(range(70, 72))
    assert embedded.code_price_pairs(page(body)).count() == 32  # 30, then the first of each further script


def test_nodes(spark):
    html = ('<div class="a b"><p>Um <b>dois</b> &amp; a < b<!-- no --> x</p><br><script>var t="</p>";</script><img src="i"/>'
            "<ul><li>1<li>2</ul></div>")
    row = spark.createDataFrame([(html,)], "h string").withColumn("nodes", page_nodes("h"))
    n = row["nodes"]
    got = row.select(
        text_of(n, select_all(n, cls("b", "a"))[0]), text_of(n, select_all(n, tag("p"))[0], " "),
        select_all(n, every(tag("img"), has("src")))[0]["attrs"]["src"], select_all(n, attr_like("class", "a "))[0]["tag"]).first()
    assert tuple(got) == ("Umdois& a < bx12", "Um dois & a < b x", "i", "div")


CARD = ('<div class="p-card"><a href="/produto/{0}/ssd?ref=1&campaign=2"><h3 class="prod-name">SSD Kingston Fury 1TB</h3><img src="//x/y.jpg"/>'
        '<div class="prod-new-price"><span>R$ 1.899,90</span></div><div class="prod-old-price"><span>R$ 2.299,90</span></div>'
        '<div class="prod-discount">-17%</div></a></div>')


def test_card(page):
    body = "".join(CARD.format(n) for n in range(3))
    got = cards.terabyte_cards(cards.with_nodes(page(body))).orderBy("pos").first()
    assert (got.price, got.original_price, got.discount_pct) == (Decimal("1899.90"), Decimal("2299.90"), Decimal("17.0"))
    assert (got.link, got.image_url) == ("https://www.terabyteshop.com.br/produto/0/ssd", "https://x/y.jpg")


def test_card_cap_and_page_fallback(page):
    pages = page("".join(CARD.format(n) for n in range(50)), "terabyte").unionByName(
        page("".join(CARD.format(n) for n in range(100, 110)), "terabyte", rank=1))
    # 35 cards of the first page are enough, the second page adds nothing
    assert collect.collect(pages, ["terabyte"]).count() == 35
    few = page("".join(CARD.format(n) for n in range(29)), "terabyte").unionByName(
        page("".join(CARD.format(n) for n in range(20, 40)), "terabyte", rank=1))
    assert collect.collect(few, ["terabyte"]).count() == 40


def test_registry():
    assert collect.enabled_sources([" KaBuM", "nowhere", "amazon"]) == ["kabum", "amazon"]


def test_aggregator_tiers(page):
    linked = '<script type="application/ld+json">{"@type":"Product","url":"https://www.pelando.com.br/d/1","name":"Produto bem bom"}</script>'
    both = page(linked + SEGMENT, "pelando")
    assert [r.extra["source"] for r in collect.collect(both, ["pelando"]).collect()] == ["pelando_rsc"]
    only = page(linked + '<a href="/d/zzz">Um titulo bem comprido</a>', "pelando")
    assert [r.extra["source"] for r in collect.collect(only, ["pelando"]).collect()] == ["pelando_json_ld"]
    plain = page('<a href="/d/zzz">Um titulo bem comprido</a>', "pelando")
    assert [r.extra["source"] for r in collect.collect(plain, ["pelando"]).collect()] == ["pelando_html"]


def test_no_break_spaces(values):
    assert values(text.price_in_text, "por R$ 1.299,90") == [1299.9]
    assert values(text.percent_in_text, "20 % off") == [20.0]
    assert values(text.coupon_in_title, "CUPOM: ABC10", "CUPOM ABC10") == ["ABC10", "ABC10"]


def test_lists_of_lists_at_any_depth(page):
    item = '{"itemListElement":[{"url":"https://www.pelando.com.br/d/1","name":"a product of four lists"}]}'
    wrap = lambda body: f'<script type="application/ld+json">{body}</script>'
    for depth in (0, 1, 2, 4, 9):
        found = embedded.linked_deals(page(wrap("[" * depth + item + "]" * depth))).collect()
        assert [r["key"] for r in found] == ["https://www.pelando.com.br/d/1"], depth
    plain = '{"url":"https://x/1","name":"long enough name"}'
    assert embedded.linked_offers(page(wrap(f"[{plain}]"))).count() == 1
    assert embedded.linked_offers(page(wrap(f"[[{plain}]]"))).count() == 0


def test_a_list_of_offers_needs_both_kinds_of_names():
    real = [{"offerId": 1}, {"offerId": 2}]
    assert embedded.find_offer_list({"a": [{"offerPrice": 1}, {"offerPrice": 2}], "b": real}) == real
    deep = {"x": real}
    for _ in range(9):
        deep = {"x": deep}
    assert embedded.find_offer_list(deep) is None and embedded.find_offer_list(deep, None) == real


def test_refused_records_do_not_pass(page):
    body = '{"data":[{"id":12,"attributes":{"title":"a title that is long","product_link":"","price":50}}]}'
    assert collect.collect(page(body, "kabum", "json"), ["kabum"]).count() == 0


def test_pages_come_before_tiers(page):
    def one(rank):
        code = f"B00000000{rank}"
        return page(f'<script>[{{"asin":"{code}","displayPrice":"R$ 20,00"}}]</script><div data-asin="C00000000{rank}" class="s-result-item">'
                    f'<h2><a href="/x"><span>a card with a long title {rank}</span></a></h2><span class="a-price"><span class="a-offscreen">'
                    'R$ 30,00</span></span></div>', "amazon", "html", rank)
    found = collect.collect(one(0).unionByName(one(1)), ["amazon"]).orderBy(*collect.ARRIVAL).collect()
    assert [(r["page_rank"], r["tier"]) for r in found] == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_best_coupon_of_the_page_is_given(page):
    block = ('{"blocks":[{"id":"1","productTitle":"a product with a long title","localizedMinPriceString":"R$ 150,00"}],'
             '"coupons":[{"couponCode":"TEN","couponValue":"R$10 off","couponLimitation":"em R$50+"},'
             '{"couponCode":"BIG","couponValue":"R$30 off","couponLimitation":"em R$120+"}]}')
    body = f"<script>a init-data-start {block} init-data-end</script>"
    assert [r["coupon_code"] for r in collect.collect(page(body, "aliexpress"), ["aliexpress"]).collect()] == ["BIG"]


def test_raw_payloads_to_published_offers(spark, page, tmp_path):
    from pyspark.sql import functions as F
    from vitrine.plans.batch import append_runs, run_batch
    item = ('{"id":%d,"attributes":{"title":"Notebook gamer rapido numero %s","product_link":"p","price":2500,"old_price":5000}}')
    raw = page('{"data":[' + ",".join([item % (1, "um"), item % (1, "um"), item % (2, "dois azul claro")]) + "]}", "kabum", "json")
    raw = raw.unionByName(page("{broken", "shopee", "json"))
    result = run_batch(raw, run_at=F.lit("2024-01-01"), enabled=["kabum", "shopee"])
    runs = {r["source"]: (r["items_found"], r["items_sent"], r["errors"], r["status"]) for r in result.runs.collect()}
    assert runs == {"kabum": (2, result.published.count(), 0, "ok"), "shopee": (0, 0, 1, "error")}
    assert result.published.count() >= 1
    for _ in range(2):
        append_runs(result.runs, f"{tmp_path}/runs", F.lit(7))
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 2


def test_plain_pages_give_the_nodes_of_the_parser():
    from vitrine.functions.html import _Flattener, _plain
    plain = ('<html><body><!-- c --><a HREF="/x?a=1&amp;b=2" hidden>t&aacute;<br/>u</A></x>v<p class="b  c">&copy; 1</p>'
             '<template>no</template><img src="<i>">end &amp')
    for page_text in (plain, "", "<p>one<p>two</p>"):
        parser = _Flattener()
        parser.feed(page_text)
        assert _plain(page_text) == parser.finish()
    for odd in ("a < b", "<p x=1>", "<script>1<2</script>", "<!doctype html>", "<a x='1'>"):
        assert _plain(odd) is None


def _seconds(frame):
    import time
    start = time.time()
    return frame.count(), time.time() - start


def test_time_of_a_card_page_grows_with_its_nodes(page):
    """Selectors with ancestors, and texts beside a link, looked at the whole page again for every card."""
    shown = '<span class="a-price" data-a-size="xl"><span class="a-offscreen">R$ 1.099,90</span></span></div>'
    body = "".join(f'<div data-asin="B{i:09d}" class="s-result-item"><h2><a href="/x"><span>A title long enough {i}</span></a></h2>{shown}' for i in range(1500))
    found, took = _seconds(cards.amazon_cards(page(body), most=None))
    assert found == 1500 and took < 30
    links = "<div>" + "".join(f'<a href="/d/{i}">ver</a><p>A title long enough {i}</p>' for i in range(1500)) + "</div>"
    found, took = _seconds(cards.deal_links(page(links)))
    assert found == 1500 and took < 30


def test_pages_are_dealt_out_before_their_texts_are_made(spark, tmp_path):
    """one exchange of narrow rows, the same for every source, instead of one of page texts for each."""
    from checks.offers_view import one_page_per_order
    from checks.payload_queries import _of, _three_sources
    lines = [(o, 1 + o % 3, o % 5, n, 1000.0 + o, 0.05, "R", "F") for o in range(1, 9) for n in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string"
                          ).withColumn("l_shipdate", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, f"part {p}", "Brand#1", "LARGE", 5, 900.0) for p in (1, 2, 3)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    pages = _three_sources(spark, str(tmp_path))
    assert pages.count() == 24
    plan = one_page_per_order(_of(spark, str(tmp_path), "terabyte"), F.col("title"), "html")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_COL" in exchanges[0]
    body = pages.filter("store = 'terabyte' and batch_id = 4").first()["body"]
    assert body.index("4-1-2-4") < body.index("4-2-2-4") and body.count("p-card") == 2
