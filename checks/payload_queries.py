"""Queries over the extractors: payloads are built from the offers, extracted, and must give them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks.offers_view import OFFERS_SQL, offers_view, one_page_per_order, table
from checks.registry import plain, query
from vitrine.functions import text
from vitrine.functions.html import decode_entities, has, every, page_nodes, select_all, tag, text_of
from vitrine.plans import batch
from vitrine.sources import cards, collect, embedded, json_api

CENTS = 1000


def _of(spark, sf, store):
    """All offers, as if one store had them: pages are built from the whole table. They are dealt out by order, before
    the long texts of the pages are made."""
    return offers_view(spark, sf, by="l_orderkey").withColumn("store", F.lit(store))


def _obj(**fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _numbers(found: DataFrame, *columns) -> DataFrame:
    return plain(found.select(*columns))


SHOP = "SELECT * FROM offers_v"
LISTED = "CASE WHEN original_cents > price_cents THEN original_cents / 100.0::DOUBLE END AS original_price"
PRICE = "price_cents / 100.0::DOUBLE AS price"


# --- JSON answers ----------------------------------------------------------------
@query(f"""{OFFERS_SQL} SELECT 'https://www.kabum.com.br/produto/' || oid || '/slug' AS link, title, {PRICE}, {LISTED},
  l_linenumber::DOUBLE AS discount_pct, category, coupon_code, free_shipping, image_url FROM ({SHOP})""")
def json_catalog(spark, sf):
    """SC1."""
    on_offer = F.col("l_linenumber") % 2 == 0
    price, listed = F.col("price"), F.col("original_price")
    deal = F.when(on_offer, F.struct(
        F.lit("deal").alias("name"), (price + 1).alias("price"), price.alias("price_with_discount"),
        F.col("l_linenumber").alias("discount_percentage")))
    labels = F.array(F.struct(F.lit("Novo").alias("title")), F.struct(F.concat(
        F.lit("Cupom "), F.col("coupon_code")).alias("title")))
    attributes = F.struct(
        F.col("title"), F.lit("slug").alias("product_link"), deal.alias("offer"),
        F.when(on_offer, listed).otherwise(price).alias("price"), F.when(~on_offer, listed).alias("old_price"),
        F.when(~on_offer, F.col("l_linenumber")).alias("discount_percentage"), F.array("image_url").alias("images"),
        F.col("free_shipping").alias("has_free_shipping"), labels.alias("stamps"), F.col("menu"))
    item = _obj(id=F.col("oid"), attributes=attributes)
    pages = one_page_per_order(_of(spark, sf, "kabum"), item, "json", '{"data":[', ",", "]}")
    return _numbers(json_api.catalog(pages), "link", "title", "price", "original_price", "discount_pct", "category",
                    "coupon_code", "free_shipping", "image_url")


@query(f"""{OFFERS_SQL} SELECT 'MLB' || oid AS key, 'https://ml.example/' || oid AS link, title, {PRICE}, {LISTED}, tenths / 10.0::DOUBLE AS discount_pct,
  free_shipping, 'https://h/D-' || l_partkey || '-O.jpg' AS image_url FROM ({SHOP}) WHERE tenths >= 100""")
def json_search(spark, sf):
    """SC2, F3."""
    item = _obj(
        id=F.concat(F.lit("MLB"), "oid"), title=F.col("title"),
        permalink=F.concat(F.lit("https://ml.example/"), "oid", F.lit("?a=1&b=2")), price=F.col("price"),
        original_price=F.col("original_price"),
        thumbnail=F.concat(F.lit("https://h/D-"), "l_partkey", F.lit("-I.jpg")),
        shipping=F.struct("free_shipping"))
    pages = one_page_per_order(_of(spark, sf, "mercadolivre"), item, "json", '{"results":[', ",", "]}")
    return _numbers(json_api.search(pages), "key", "link", "title", "price", "original_price", "discount_pct",
                    "free_shipping", "image_url")


def _scaled_item():
    odd = F.col("l_linenumber") % 2 == 1
    bare = _obj(
        name=F.col("title"), itemid=F.concat(F.col("l_orderkey"), F.lit("00"), F.col("l_linenumber")),
        shopid=F.col("l_partkey") + 1, price=F.when(odd, F.col("price_cents") * CENTS),
        price_min=F.col("price_cents") * CENTS, price_before_discount=F.col("original_cents") * CENTS,
        raw_discount=F.concat(F.lit("-"), F.col("l_linenumber"), F.lit("%")), image=F.lit("pic"),
        voucher_info=F.struct(F.col("coupon_code").alias("voucher_code")), free_shipping=F.col("free_shipping"))
    return bare, odd


_SCALED = f"""{OFFERS_SQL} SELECT l_orderkey || '00' || l_linenumber AS key, title,
  'https://shopee.com.br/product/' || (l_partkey + 1) || '/' || l_orderkey || '00' || l_linenumber AS link, {PRICE}, {LISTED},
  l_linenumber::DOUBLE AS discount_pct, coupon_code, free_shipping FROM ({SHOP}) WHERE price_cents > 0"""
_SCALED_COLUMNS = ("key", "title", "link", "price", "original_price", "discount_pct", "coupon_code", "free_shipping")


@query(_SCALED)
def json_wrapped(spark, sf):
    """SC3: wrapped and bare items, alternative field names."""
    bare, odd = _scaled_item()
    item = F.when(odd, F.concat(F.lit('{"item_basic":'), bare, F.lit("}"))).otherwise(bare)
    pages = one_page_per_order(_of(spark, sf, "shopee"), item, "json", '{"items":[', ",", "]}")
    return _numbers(json_api.wrapped(pages), *_SCALED_COLUMNS)


@query(_SCALED)
def page_state(spark, sf):
    """SC4."""
    pages = one_page_per_order(
        _of(spark, sf, "shopee"), _scaled_item()[0], "html",
        '<script>window.__INITIAL_STATE__ = {"flashSale":{"items":[', ",", "]}};</script>")
    return _numbers(embedded.page_state(pages), *_SCALED_COLUMNS)


@query(f"""{OFFERS_SQL} SELECT oid AS key, title, 'https://out.example/' || oid || '?color=' || l_linenumber AS link, {PRICE}, {LISTED},
  CASE WHEN tenths > 0 THEN tenths / 10.0::DOUBLE END AS discount_pct, coupon_code,
  'https://www.promobit.com.br/i/' || l_partkey AS image_url, CASE WHEN origin = '' THEN 'Shop' ELSE origin END AS origin_store
  FROM ({SHOP})""")
def next_state(spark, sf):
    """SC5, P14, P20: known place on even orders, a deep unknown place on odd ones."""
    item = _obj(
        offerId=F.col("oid"), offerTitle=F.col("title"), offerPrice=F.col("price"), oldPrice=F.col("original_price"),
        offerLink=F.concat(F.lit("https://www.promobit.com.br/x/"), "oid"),
        redirectUrl=F.concat(F.lit("https://out.example/"), "oid", F.lit("?utm_source=a&color="), "l_linenumber", F.lit("&tag=b")),
        offerCoupon=F.struct(F.col("coupon_code").alias("code")),
        offerPhoto=F.struct(F.concat(F.lit("/i/"), "l_partkey").alias("url")), storeName=F.col("origin"),
        store=F.struct(F.lit("Shop").alias("name")))
    begin, end = '<html><script id="__NEXT_DATA__" type="application/json">', "</script></html>"
    offers = _of(spark, sf, "promobit")
    known = one_page_per_order(
        offers.filter("l_orderkey % 2 = 0"), item, "html",
        begin + '{"props":{"pageProps":{"serverOffers":{"offers":[', ",", "]}}}}" + end)
    # the search wants a list of at least two entries
    deep = one_page_per_order(
        offers.filter("l_orderkey % 2 = 1"), item, "html",
        begin + '{"page":{"blocks":[{"x":1},{"cells":[', ",", ',{"offerId":null}]}]}}' + end)
    found = embedded.board_state(known.unionByName(deep))
    return _numbers(
        found.withColumn("origin_store", F.col("extra")["origin_store"]), "key", "title", "link", "price",
        "original_price", "discount_pct", "coupon_code", "image_url", "origin_store")


@query(f"""{OFFERS_SQL} SELECT 'https://www.pelando.com.br/d/' || oid AS key, title || ' por R$ ' || translate(format('{{:,.2f}}', price_cents / 100.0::DOUBLE), ',.', '.,') AS title, {PRICE} FROM ({SHOP})""")
def json_ld_deals(spark, sf):
    """SC6, P5: parts of the main entity, list elements with inner items, foreign domains dropped."""
    url = F.concat(F.lit("https://www.pelando.com.br/d/"), "oid")
    name = F.concat("title", F.lit(" por "), text.brl(F.col("price")))
    kind = F.col("l_linenumber") % 3
    item = F.when(kind == 0, _obj(url=url, name=name)).when(
        kind == 1, F.concat(F.lit('{"@type":"ListItem","item":'), _obj(url=url, name=name), F.lit("}"))).otherwise(
        _obj(**{"@id": url, "headline": name, "image": F.array(F.lit("http://i"))}))
    pages = one_page_per_order(
        _of(spark, sf, "pelando"), item, "html",
        '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"url":"https://other.example/a","name":"something long"},',
        ",", "]}</script>")
    return _numbers(embedded.linked_deals(pages), "key", "title", "price")


@query(f"{OFFERS_SQL} SELECT 'https://p.example/' || oid AS key, title FROM ({SHOP})")
def json_ld_offers(spark, sf):
    """SC6."""
    item = _obj(**{"url": F.concat(F.lit("https://p.example/"), "oid"), "name": F.col("title")})
    pages = one_page_per_order(
        _of(spark, sf, "promobit"), item, "html", '<script type="application/ld+json">[', ",", "]</script>")
    return embedded.linked_offers(pages).select("key", "title")


@query("""SELECT p.store, p.payloads, p.errors FROM (SELECT CASE WHEN event_type = 'error' THEN 'bad' ELSE event_type END AS store,
  count(*) AS payloads, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1) p""")
def payload_errors(spark, sf):
    """SC22, A9: truncated JSON is counted, not fatal."""
    e = table(spark, sf, "events")
    bad = F.col("event_type") == "error"
    return collect.payload_errors(e.select(
        F.when(bad, "bad").otherwise(F.col("event_type")).alias("store"), F.lit("json").alias("kind"),
        F.when(bad, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("body")))


# --- serialised text ----------------------------------------------------------------
_UUID = "concat(lpad(cast(l_partkey as string), 8, '0'), '-0000-4000-8000-', lpad(cast(l_orderkey * 10 + l_linenumber as string), 12, '0'))"


@query(f"""{OFFERS_SQL} SELECT lpad(l_partkey::VARCHAR, 8, '0') || '-0000-4000-8000-' || lpad((l_orderkey * 10 + l_linenumber)::VARCHAR, 12, '0') AS key,
  title, CASE WHEN l_linenumber % 2 = 0 THEN 'https://out.example/' || oid || '?a=' || l_linenumber ELSE 'https://www.pelando.com.br/d/s' || l_partkey END AS link,
  {PRICE}, l_linenumber::DOUBLE AS discount_pct, CASE WHEN l_linenumber = 2 THEN 'coupon' ELSE 'promotion' END AS category,
  coalesce(coupon_code, CASE WHEN l_linenumber = 2 THEN 'VER NA LOJA' END) AS coupon_code, free_shipping,
  'Loja ' || l_suppkey AS origin_store FROM ({SHOP}) WHERE l_linenumber <> 7""")
def segment_scan(spark, sf):
    """SC7, F5, F9, P33, P36."""
    q = lambda name, value: F.concat(F.lit(f',"{name}":[0,'), value, F.lit("]"))
    quoted = lambda value: F.concat(F.lit('"'), value, F.lit('"'))
    line = F.col("l_linenumber")
    piece = F.concat(
        F.lit('"id":[0,"'), F.expr(_UUID), F.lit('"]'),
        q("slug", quoted(F.concat(F.lit("s"), "l_partkey"))), q("title", quoted(F.col("title"))),
        q("price", F.col("price").cast("string")), q("discountPercentage", line.cast("string")),
        q("status", F.when(line == 7, '"expired"').otherwise('"active"')),
        q("freeShipping", F.col("free_shipping").cast("string")),
        q("store", F.concat(F.lit('{"id":[0,"1"],"name":[0,"Loja '), "l_suppkey", F.lit('"],"slug":[0,"x"]}'))),
        F.when(F.col("coupon_code").isNotNull(), q("couponCode", quoted(F.col("coupon_code")))).otherwise(""),
        q("kind", F.when(line == 2, '"coupon"').otherwise('"promotion"')),
        F.when(line % 2 == 0, q("sourceUrl", quoted(F.concat(
            F.lit("https://out.example/"), "oid", F.lit("?ref=1&a="), line)))).otherwise(""))
    # the page carries the text with quotes as entities
    pages = one_page_per_order(
        _of(spark, sf, "pelando"), F.replace(piece, F.lit('"'), F.lit("&quot;")), "html", "<div data='", "", "'>")
    return _numbers(
        embedded.component_text(pages).withColumn("origin_store", F.col("extra")["origin_store"]), "key", "title", "link",
        "price", "discount_pct", "category", "coupon_code", "free_shipping", "origin_store")


def _inline(pages_piece, offers, before, after):
    return one_page_per_order(
        offers, pages_piece, "html", "<script>var x</script><script>a init-data-start " + before, ",", after + " init-data-end</script>")


@query(f"""{OFFERS_SQL} SELECT oid AS key, 'https://pt.aliexpress.com/item/' || oid || '.html' AS link, title, {PRICE},
  original_cents / 100.0::DOUBLE AS original_price, l_linenumber::DOUBLE AS discount_pct, 'https://cdn/' || l_partkey AS image_url
  FROM ({SHOP})""")
def inline_block(spark, sf):
    """SC8, SC9: the object around every title, nested objects inside it included."""
    obj = _obj(
        id=F.col("oid"), more=F.struct(F.struct(F.lit(1).alias("b")).alias("a")), productTitle=F.col("title"),
        localizedMinPriceString=text.brl(F.col("price")), oriMinPrice=F.col("original_price"),
        discount=F.col("l_linenumber"), productImage=F.concat(F.lit("//cdn/"), "l_partkey"))
    pages = _inline(obj, _of(spark, sf, "aliexpress"), '{"blocks":[', "]}")
    return _numbers(embedded.title_blocks(pages), "key", "link", "title", "price", "original_price", "discount_pct", "image_url")


@query(f"""{OFFERS_SQL} SELECT oid AS key, CASE WHEN l_linenumber > 1 THEN 'Super Deal -' || l_linenumber || '% OFF' ELSE 'Super Deal AliExpress' END AS title,
  {PRICE}, original_cents / 100.0::DOUBLE AS original_price, CASE WHEN l_linenumber > 1 THEN l_linenumber::DOUBLE END AS discount_pct FROM ({SHOP})""")
def item_list(spark, sf):
    """SC10, P37."""
    obj = _obj(
        itemId=F.col("oid"), price=text.brl(F.col("price")), originPrice=F.col("original_price"),
        discountRate=F.when(F.col("l_linenumber") > 1, F.concat(F.lit("-"), "l_linenumber", F.lit("%"))))
    pages = _inline(obj, _of(spark, sf, "aliexpress"), '{"itemList":[', "]}")
    return _numbers(embedded.item_list(pages), "key", "title", "price", "original_price", "discount_pct")


@query(f"""{OFFERS_SQL} SELECT DISTINCT l_orderkey AS batch_id, 'C' || l_partkey AS code, l_partkey::DOUBLE AS min_value, (l_partkey % 50)::DOUBLE AS discount_value
  FROM ({SHOP})""")
def coupon_scan(spark, sf):
    """SC11, W1: the first occurrence of every code of a page."""
    from vitrine.operators.tiers import keep_first
    obj = _obj(
        couponCode=F.concat(F.lit("C"), "l_partkey"), couponValue=F.concat(F.lit("R$"), F.col("l_partkey") % 50, F.lit(" off")),
        couponLimitation=F.concat(F.lit("em R$"), "l_partkey", F.lit("+")))
    pages = _inline(obj, _of(spark, sf, "aliexpress"), '{"coupons":[', "]}")
    firsts = keep_first(embedded.coupon_rows(pages), ["batch_id", "store", "code"], ["page_rank", "pos"])
    return _numbers(firsts, "batch_id", "code", "min_value", "discount_value")


@query(f"""{OFFERS_SQL} SELECT 'https://www.amazon.com.br/dp/B' || lpad(l_partkey::VARCHAR, 9, '0') AS link,
  'Oferta Amazon — ASIN B' || lpad(l_partkey::VARCHAR, 9, '0') AS title, {PRICE} FROM ({SHOP}) WHERE price_cents > 0""")
def script_pairs(spark, sf):
    """SC12."""
    obj = _obj(asin=F.concat(F.lit("B"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")), x=F.lit(1), displayPrice=text.brl(F.col("price")))
    pages = one_page_per_order(_of(spark, sf, "amazon"), obj, "html", "<script>var deals = [", ",", "]</script><script>none</script>")
    return _numbers(embedded.code_price_pairs(pages), "link", "title", "price")


@query("SELECT doc_id, md5(text) AS same FROM documents")
def entities(spark, sf):
    """Whole documents, escaped and decoded again."""
    escaped = F.col("text")
    for plain_text, entity in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("é", "&eacute;"), ("ç", "&#231;")):
        escaped = F.replace(escaped, F.lit(plain_text), F.lit(entity))
    return table(spark, sf, "documents").select("doc_id", F.md5(decode_entities(escaped)).alias("same"))


# --- cards ---------------------------------------------------------------------------------
def _tag(name, inner, attrs=""):
    return F.concat(F.lit(f"<{name} {attrs}>"), inner, F.lit(f"</{name}>"))


def _card_pages(spark, sf, store, card):
    return cards.with_nodes(one_page_per_order(_of(spark, sf, store), card, "html", "<html><body><!-- cards -->", "\n", "</body></html>"))


@query(f"""{OFFERS_SQL} SELECT 'https://www.amazon.com.br/dp/B' || lpad(l_partkey::VARCHAR, 9, '0') AS link, title, {PRICE}, {LISTED}, l_linenumber::DOUBLE AS discount_pct,
  coupon_code, free_shipping, 'https://i/I/p' || l_partkey || '._AC_SX679_.jpg' AS image_url FROM ({SHOP})""")
def html_cards_amazon(spark, sf):
    """SC13, P21, P22, P23."""
    card = F.concat(
        F.lit('<div data-asin="B'), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lit('" class="s-result-item">'),
        _tag("h2", _tag("a", _tag("span", F.col("title")), 'href="/x"')),
        F.lit('<span class="a-price" data-a-size="xl"><span class="a-offscreen">'), text.brl(F.col("price")), F.lit("</span></span>"),
        F.lit('<span class="a-price a-text-price"><span class="a-offscreen">'), text.brl(F.col("original_price")), F.lit("</span></span>"),
        F.lit('<b class="badge-savings">'), F.col("l_linenumber"), F.lit("% off</b>"),
        F.when(F.col("coupon_code").isNotNull(), F.concat(
            F.lit('<i class="x-coupon">'), F.col("coupon_code"), F.lit(" %</i>"))).otherwise(""),
        F.when(F.col("free_shipping"), "<p>Frete <u>Grátis</u></p>").otherwise(""),
        F.lit('<img src="https://i/I/p'), F.col("l_partkey"), F.lit('._AC_UL320_.jpg"></div>'))
    return _numbers(cards.amazon_cards(_card_pages(spark, sf, "amazon", card)), "link", "title", "price", "original_price",
                    "discount_pct", "coupon_code", "free_shipping", "image_url")


@query(f"""{OFFERS_SQL} SELECT 'MLB' || l_partkey AS key, title, 'https://www.mercadolivre.com.br/MLB-' || l_partkey AS link, {PRICE}, original_cents / 100.0::DOUBLE AS original_price,
  l_linenumber * 5::DOUBLE AS discount_pct FROM ({SHOP}) WHERE tenths >= 100 OR l_linenumber * 5 >= 10 AND (tenths IS NOT NULL OR true)""")
def html_cards_mercadolivre(spark, sf):
    """SC14, F3."""
    fraction = 'class="andes-money-amount__fraction"'
    card = F.concat(
        F.lit('<li class="ui-search-result"><a href="https://www.mercadolivre.com.br/MLB-'), F.col("l_partkey"), F.lit('?x=1">'),
        _tag("h2", F.col("title")), F.lit("</a>"), _tag("span", text.brl(F.col("price")), fraction),
        _tag("s", _tag("span", text.brl(F.col("original_price")), fraction)),
        F.lit('<i class="y-discount">'), F.col("l_linenumber") * 5, F.lit("% OFF</i></li>"))
    return _numbers(cards.mercadolivre_cards(_card_pages(spark, sf, "mercadolivre", card)), "key", "title", "link", "price",
                    "original_price", "discount_pct")


@query(f"""{OFFERS_SQL} SELECT 'https://www.terabyteshop.com.br/produto/' || oid AS link, title, {PRICE}, {LISTED},
  CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber::DOUBLE WHEN tenths > 0 THEN tenths / 10.0::DOUBLE END AS discount_pct, coupon_code, free_shipping,
  'https://www.terabyteshop.com.br/i/' || l_partkey || '.jpg' AS image_url FROM ({SHOP})""")
def html_cards_terabyte(spark, sf):
    """SC15, P19, P22, P23."""
    card = F.concat(
        F.lit('<a class="p-card" href="/produto/'), F.col("oid"), F.lit('?ref=x&campaign=y">'),
        _tag("h3", F.col("title"), 'class="prod-name"'), F.lit('<img src="/i/'), F.col("l_partkey"), F.lit('.jpg"/>'),
        _tag("div", _tag("span", text.brl(F.col("price"))), 'class="prod-new-price"'),
        _tag("div", _tag("span", text.brl(F.col("original_price"))), 'class="prod-old-price"'),
        F.when(F.col("l_linenumber") % 2 == 0, _tag("div", F.concat(F.lit("-"), F.col("l_linenumber"), F.lit("%")), 'class="prod-discount"')).otherwise(""),
        F.when(F.col("coupon_code").isNotNull(), _tag("em", F.concat(F.lit("Cupom: "), F.lower("coupon_code")), 'class="badge-cupom"')).otherwise(""),
        F.when(F.col("free_shipping"), "<p>Frete Gr&aacute;tis</p>").otherwise(""), F.lit("</a>"))
    return _numbers(cards.terabyte_cards(_card_pages(spark, sf, "terabyte", card)), "link", "title", "price", "original_price",
                    "discount_pct", "coupon_code", "free_shipping", "image_url")


@query(f"""{OFFERS_SQL} SELECT 'https://shopee.com.br/product/' || l_suppkey || '/' || l_partkey AS link, title, {PRICE}, l_partkey::VARCHAR AS key FROM ({SHOP})""")
def html_cards_shopee(spark, sf):
    """SC16."""
    card = F.concat(
        F.lit('<div class="a product-item"><a href="/product/'), F.col("l_suppkey"), F.lit("/"), F.col("l_partkey"), F.lit('">'),
        _tag("div", F.col("title"), 'class="item-name"'), _tag("span", text.brl(F.col("price")), 'class="x-price"'), F.lit("</a></div>"))
    return _numbers(cards.shopee_cards(_card_pages(spark, sf, "shopee", card)), "link", "title", "price", "key")


@query(f"""{OFFERS_SQL} SELECT 'https://www.promobit.com.br/oferta/' || oid AS key, title, {PRICE}, origin AS origin_store FROM ({SHOP})""")
def html_cards_promobit(spark, sf):
    """SC17."""
    card = F.concat(
        F.lit('<div class="x OfferCard"><a href="/oferta/'), F.col("oid"), F.lit('">'), _tag("h2", F.col("title")),
        F.lit("</a>"), _tag("span", text.brl(F.col("price")), 'class="Price"'),
        _tag("i", F.replace("origin", F.lit("&"), F.lit("&amp;")), 'class="retailer"'), F.lit("</div>"))
    found = cards.promobit_cards(_card_pages(spark, sf, "promobit", card))
    return _numbers(found.withColumn("origin_store", F.col("extra")["origin_store"]), "key", "title", "price", "origin_store")


@query(f"""{OFFERS_SQL} SELECT 'https://www.pelando.com.br/d/' || oid AS key, title || ' R$ ' || translate(format('{{:,.2f}}', price_cents / 100.0::DOUBLE), ',.', '.,') AS title, {PRICE} FROM ({SHOP})""")
def html_links_deals(spark, sf):
    """SC18: the title stands beside the link."""
    card = F.concat(
        F.lit('<div><a href="/d/'), F.col("oid"), F.lit('">ver</a>'),
        _tag("p", F.concat("title", F.lit(" "), text.brl(F.col("price")))), F.lit("</div>"))
    return _numbers(cards.deal_links(_card_pages(spark, sf, "pelando", card)), "key", "title", "price")


@query(f"""{OFFERS_SQL} SELECT l_partkey::VARCHAR AS key, title, {PRICE}, 'https://cdn/' || l_partkey AS image_url FROM ({SHOP})""")
def html_links_items(spark, sf):
    """SC18: title, price and picture come from the card around the link."""
    card = F.concat(
        F.lit('<div class="Card"><div><a href="/item/'), F.col("l_partkey"), F.lit('.html">x</a>'), _tag("h3", F.col("title")),
        F.lit("</div>"), _tag("i", text.brl(F.col("price")), 'class="price"'), F.lit('<img src="//cdn/'), F.col("l_partkey"), F.lit('"></div>'))
    return _numbers(cards.item_links(_card_pages(spark, sf, "aliexpress", card)), "key", "title", "price", "image_url")


@query("""SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS links,
  len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages""")
def page_links(spark, sf):
    """UD2 on the captured pages: nodes of whole pages."""
    nodes = table(spark, sf, "pages").withColumn("nodes", page_nodes("html"))
    n = F.col("nodes")
    return nodes.select(
        "page_id", F.size(select_all(n, every(tag("a"), has("href")))).cast("bigint").alias("links"),
        F.size(select_all(n, tag("p"))).cast("bigint").alias("paragraphs"))


_DECODED = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
for _entity, _letter in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
    _DECODED = f"replace({_DECODED}, '&{_entity};', '{_letter}')"


@query(f"SELECT page_id, trim({_DECODED}) AS title FROM pages")
def page_titles(spark, sf):
    """UD2: the title text of whole captured pages."""
    nodes = table(spark, sf, "pages").withColumn("nodes", page_nodes("html"))
    n = F.col("nodes")
    return nodes.select("page_id", text_of(n, F.try_element_at(select_all(n, tag("title")), F.lit(1))).alias("title"))


def _three_sources(spark, sf):
    kabum = _obj(id=F.col("oid"), attributes=F.struct(F.col("title"), F.lit("s").alias("product_link"), F.col("price")))
    answers = one_page_per_order(_of(spark, sf, "kabum"), kabum, "json", '{"data":[', ",", "]}")
    search = _obj(id=F.col("oid"), title=F.col("title"), permalink=F.lit("https://m/1"), price=F.col("price"), original_price=F.col("original_price"))
    found = one_page_per_order(_of(spark, sf, "mercadolivre"), search, "json", '{"results":[', ",", "]}")
    card = F.concat(F.lit('<a class="p-card" href="/produto/'), F.col("oid"), F.lit('">'), _tag("h3", F.col("title")), F.lit("</a>"))
    shop = one_page_per_order(_of(spark, sf, "terabyte"), card, "html")
    return answers.unionByName(found).unionByName(shop)


_THREE = f"""{OFFERS_SQL}, three AS (SELECT 'kabum' AS source, price_cents > 0 AS fits FROM offers_v
  UNION ALL SELECT 'mercadolivre', price_cents > 0 AND tenths >= 100 FROM offers_v UNION ALL SELECT 'terabyte', true FROM offers_v)"""


@query(f"{_THREE} SELECT source AS store, count(*) AS offers FROM three WHERE fits GROUP BY 1")
def collect_all(spark, sf):
    """UD2, UD3, O1, O2, SC21: three sources through the registry, valid offers per source."""
    return collect.collect(_three_sources(spark, sf), [" KaBuM", "terabyte", "mercadolivre", "nowhere"]).groupBy(
        "store").agg(F.count("*").alias("offers"))


@query(f"""{_THREE} SELECT source, count(*) FILTER (fits) AS items_found, 0::BIGINT AS errors, 'ok' AS status FROM three GROUP BY 1
  UNION ALL SELECT 'shopee', 0, 2, 'error' UNION ALL SELECT 'amazon', 0, 1, 'timeout'""")
def run_log_sources(spark, sf):
    """UD3, SK3: the run log of three sources with payloads, one with unreadable answers, one that timed out."""
    raw = _three_sources(spark, sf)
    bad = spark.createDataFrame([(1, "shopee", "https://x", k, None, "json", '{"items":[') for k in (0, 1)], raw.schema)
    timing = spark.createDataFrame([("amazon", 45.0, "timeout"), ("kabum", 2.0, None)], "source string, duration_secs double, failure string")
    enabled = ["kabum", "terabyte", "mercadolivre", "shopee", "amazon"]
    found = collect.collect(raw.unionByName(bad), enabled)
    runs = batch.source_runs(raw.unionByName(bad), found, found.limit(0), enabled, F.lit("2024-01-01"), timing)
    return runs.select("source", "items_found", "errors", "status")
