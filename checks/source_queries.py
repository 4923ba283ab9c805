"""Queries over assembled sources: several pages a batch, tiers, fallbacks, repeats, page stops and coupons."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.offers_view import ARRIVAL, ARRIVAL_SQL, OFFERS_SQL, offers_view
from checks.payload_queries import _numbers, _obj, _tag
from checks.registry import query
from vitrine.functions import text
from vitrine.sources import collect, templates
from vitrine.sources.collect import Limits

# Numbers begin with one, as a zero counts as no id.
#: A batch is the orders of 16 numbers, a page its lines of one number.
BATCH = "l_orderkey div 16"
_O = f"""{OFFERS_SQL}, o AS (SELECT *, l_orderkey // 16 AS b, l_linenumber - 1 AS page,
  row_number() OVER (PARTITION BY l_orderkey // 16, l_linenumber ORDER BY {ARRIVAL_SQL}) - 1 AS pos FROM offers_v)"""


def _pages(offers, store, piece, kind, before="", between="", after="", url="https://feed.example/"):
    pieces = F.sort_array(F.collect_list(F.struct(*ARRIVAL, piece.alias("piece"))))
    return offers.groupBy(F.expr(BATCH).alias("batch_id"), (F.col("l_linenumber") - 1).cast("int").alias("page_rank")).agg(
        pieces.alias("pieces")).select(
        F.col("batch_id").cast("long"), F.lit(store).alias("store"), F.concat(F.lit(url), F.col("page_rank")).alias("page_url"), "page_rank",
        F.lit(None).cast("timestamp").alias("fetched_at"), F.lit(kind).alias("kind"),
        F.concat(F.lit(before), F.array_join(F.col("pieces.piece"), between), F.lit(after)).alias("body"))


def _first(tier: str, key: str, order: str = "page, tier, pos") -> str:
    """The first of each key in a batch."""
    return f"SELECT *, {tier} AS tier, {key} AS key FROM o QUALIFY row_number() OVER (PARTITION BY b, {key} ORDER BY {order}) = 1"


# --- batch answers, searches, page ----------------------------------------------------
_SHOPEE_TIER = "CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber <= 3 THEN 1 ELSE 2 END"
_SHOPEE_FIRST = f"""{_O}, usable AS (SELECT *, {_SHOPEE_TIER} AS tier, (l_partkey + 1)::VARCHAR AS key FROM o WHERE price_cents > 0),
  firsts AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY b, key ORDER BY tier, page, pos) = 1)"""


def _shopee(spark, sf):
    offers = offers_view(spark, sf)
    item = _obj(name=F.col("title"), itemid=F.col("l_partkey") + 1, shopid=F.lit(7), price=F.col("price_cents") * 1000,
                price_before_discount=F.col("original_cents") * 1000)
    wrapped = F.concat(F.lit('{"item_basic":'), item, F.lit("}"))
    return _pages(offers.filter("l_linenumber = 1"), "shopee", item, "json", '{"data":{"items":[', ",", "]}}").unionByName(
        _pages(offers.filter("l_linenumber between 2 and 3"), "shopee", wrapped, "json", '{"items":[', ",", "]}")).unionByName(
        _pages(offers.filter("l_linenumber > 3"), "shopee", item, "html", '<script>window.__INITIAL_STATE__ = {"flashSale":{"items":[', ",", "]}};</script>"))


@query(f"""{_SHOPEE_FIRST}, tiers AS (SELECT *, rank() OVER (PARTITION BY b ORDER BY tier) AS r FROM firsts
    QUALIFY r <= CASE tier WHEN 2 THEN 5 ELSE 10 END)
  SELECT b AS batch_id, key, title, price_cents / 100.0::DOUBLE AS price, tier FROM tiers
  QUALIFY rank() OVER (PARTITION BY b ORDER BY tier, page) <= CASE tier WHEN 2 THEN 5 ELSE 25 END""")
def source_shopee(spark, sf):
    """SC3, SC4, O1, O2, W1: batch answers first, searches and the page only while there are too few."""
    return _numbers(collect.shopee(_shopee(spark, sf)), "batch_id", "key", "title", "price", "tier")


@query(f"{_SHOPEE_FIRST} SELECT b AS batch_id, key, title, price_cents / 100.0::DOUBLE AS price, tier FROM firsts")
def source_shopee_unlimited(spark, sf):
    """The same with all limits lifted."""
    return _numbers(collect.shopee(_shopee(spark, sf), Limits.none()), "batch_id", "key", "title", "price", "tier")


# --- state of the page, else cards ------------------------------------------------------------
@query(f"""{_O}, kinds AS (SELECT *, (b + page) % 2 AS tier FROM o),
  firsts AS (SELECT * FROM kinds QUALIFY row_number() OVER (PARTITION BY b, tier, l_partkey ORDER BY page, pos) = 1)
  SELECT b AS batch_id, (l_partkey + 1)::VARCHAR AS part, title, price_cents / 100.0::DOUBLE AS price, 2 * tier AS tier FROM firsts
  QUALIFY rank() OVER (PARTITION BY b ORDER BY page) <= 30""")
def source_promobit(spark, sf):
    """SC5, SC17, O2, O4: state where a page has it, else cards; pages until there are thirty offers."""
    offers = offers_view(spark, sf)
    state = _obj(offerId=F.col("l_partkey") + 1, offerTitle=F.col("title"), offerPrice=F.col("price"), offerLink=F.concat(F.lit("https://out.example/"), "l_partkey"))
    card = F.concat(F.lit('<div class="x OfferCard"><a href="/oferta/'), F.col("l_partkey") + 1, F.lit('">'), _tag("h2", F.col("title")),
                    F.lit("</a>"), _tag("span", text.brl(F.col("price")), 'class="Price"'), F.lit("</div>"))
    even = F.expr(f"({BATCH} + l_linenumber - 1) % 2 = 0")
    pages = _pages(offers.filter(even), "promobit", state, "html", '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"serverOffers":{"offers":[',
                   ",", "]}}}}</script>").unionByName(_pages(offers.filter(~even), "promobit", card, "html", "<html><body>", "\n", "</body></html>"))
    found = collect.promobit(pages)
    return _numbers(found.withColumn("part", F.regexp_extract("key", "([0-9]+)$", 1)), "batch_id", "part", "title", "price", "tier")


# --- codes and prices in scripts, and cards --------------------------------------------------------
_ASIN = "'B' || lpad(l_partkey::VARCHAR, 9, '0')"


@query(f"""{_O}, usable AS (SELECT *, page % 2 AS tier FROM o WHERE (page % 2 = 1 OR price_cents > 0)),
  firsts AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY b, l_partkey ORDER BY page, tier, pos) = 1)
  SELECT b AS batch_id, 'https://www.amazon.com.br/dp/' || {_ASIN} AS link, CASE tier WHEN 0 THEN 'Oferta Amazon — ASIN ' || {_ASIN} ELSE title END AS title,
  price_cents / 100.0::DOUBLE AS price, tier FROM firsts QUALIFY rank() OVER (PARTITION BY b ORDER BY page) <= 20""")
def source_amazon(spark, sf):
    """SC12, SC13, F4, O2: scripts and cards by page until there are twenty offers; digital goods are left out."""
    offers, asin = offers_view(spark, sf), F.concat(F.lit("B"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    pair = _obj(asin=asin, displayPrice=text.brl(F.col("price")))
    shown = F.concat(F.lit('<span class="a-price" data-a-size="xl"><span class="a-offscreen">'), text.brl(F.col("price")), F.lit("</span></span></div>"))
    head = lambda code, title: F.concat(F.lit('<div data-asin="'), code, F.lit('" class="s-result-item">'), _tag("h2", _tag("a", _tag("span", title), 'href="/x"')), shown)
    # a film stands before every card
    card = F.concat(head(F.concat(F.lit("D"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")), F.concat(F.lit("Filme "), "title")), head(asin, F.col("title")))
    pages = _pages(offers.filter("l_linenumber % 2 = 1"), "amazon", pair, "html", "<script>var deals = [", ",", "]</script>").unionByName(
        _pages(offers.filter("l_linenumber % 2 = 0"), "amazon", card, "html", "<html><body>", "\n", "</body></html>"))
    return _numbers(collect.amazon(pages), "batch_id", "link", "title", "price", "tier")


# --- linked data, else links; the first page that has any ---------------------------------------------
_DEAL = "'https://www.pelando.com.br/d/' || l_partkey"
_BRL = "translate(format('{:,.2f}', price_cents / 100.0::DOUBLE), ',.', '.,')"


@query(f"""{_O}, filled AS (SELECT *, CASE WHEN page % 2 = 0 THEN 1 ELSE 2 END AS tier FROM o WHERE NOT (b % 3 = 0 AND page = 0)),
  firsts AS (SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY b, tier, l_partkey ORDER BY page, pos) = 1)
  SELECT b AS batch_id, {_DEAL} AS key, title || ' R$ ' || {_BRL} AS title, price_cents / 100.0::DOUBLE AS price, tier
  FROM firsts QUALIFY rank() OVER (PARTITION BY b ORDER BY page) <= 1""")
def source_pelando(spark, sf):
    """SC6, SC18, O2: linked data where a page has it, else links with their cards; the first page that gives any."""
    offers, url = offers_view(spark, sf), F.concat(F.lit("https://www.pelando.com.br/d/"), "l_partkey")
    named = F.concat("title", F.lit(" "), text.brl(F.col("price")))
    broken = F.expr(f"{BATCH} % 3 = 0 and l_linenumber = 1")
    card = F.concat(F.lit('<div><a href="/d/'), F.col("l_partkey"), F.lit('">ver</a>'), _tag("p", named), F.lit("</div>"))
    linked = offers.filter("l_linenumber % 2 = 1")
    pages = _pages(linked.filter(~broken), "pelando", _obj(url=url, name=named), "html", '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[', ",", "]}</script>")
    pages = pages.unionByName(_pages(linked.filter(broken), "pelando", F.lit("x"), "html", '<script type="application/ld+json">{bad', "", "</script>")).unionByName(
        _pages(offers.filter("l_linenumber % 2 = 0"), "pelando", card, "html", "<html><body>", "\n", "</body></html>"))
    return _numbers(collect.pelando(pages), "batch_id", "key", "title", "price", "tier")


# --- landing page with coupons, searches as a fallback -------------------------------------------------
@query(f"""{_O}, usable AS (SELECT *, CASE WHEN page = 0 THEN 0 ELSE 1 END AS tier FROM o),
  firsts AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY b, l_partkey ORDER BY tier, page, pos) = 1),
  kept AS (SELECT * FROM firsts QUALIFY rank() OVER (PARTITION BY b ORDER BY tier) <= 5),
  coupons AS (SELECT b, 'C' || l_partkey AS code, l_partkey % 500 + 1 AS least, l_partkey % 50 AS worth, pos FROM o WHERE page = 0
    QUALIFY row_number() OVER (PARTITION BY b, l_partkey ORDER BY pos) = 1)
  SELECT k.b AS batch_id, (l_partkey + 1)::VARCHAR AS key, any_value(title) AS title, any_value(price_cents) / 100.0::DOUBLE AS price, any_value(tier) AS tier,
    arg_max(code, worth * 100000 - c.pos) AS coupon_code
  FROM kept k LEFT JOIN coupons c ON c.b = k.b AND price_cents >= 100 * c.least GROUP BY k.b, k.l_orderkey, k.l_linenumber, k.l_partkey, k.l_suppkey""")
def source_aliexpress(spark, sf):
    """SC8, SC9, SC11, J5, O2: the landing page with its coupons; searches only where it gave fewer than five offers."""
    offers = offers_view(spark, sf)
    block = _obj(id=F.col("l_partkey") + 1, productTitle=F.col("title"), localizedMinPriceString=text.brl(F.col("price")))
    coupon = _obj(couponCode=F.concat(F.lit("C"), "l_partkey"), couponValue=F.concat(F.lit("R$"), F.col("l_partkey") % 50, F.lit(" off")),
                  couponLimitation=F.concat(F.lit("em R$"), F.col("l_partkey") % 500 + 1, F.lit("+")))
    begin, end = "<script>var x</script><script>a init-data-start {\"blocks\":[", "]} init-data-end</script>"
    pages = _pages(offers.filter("l_linenumber = 1"), "aliexpress", F.concat(block, F.lit(","), coupon), "html", begin, ",", end).unionByName(
        _pages(offers.filter("l_linenumber > 1"), "aliexpress", block, "html", begin, ",", end, url="https://feed.example/wholesale-"))
    return _numbers(collect.aliexpress(pages), "batch_id", "key", "title", "price", "tier", "coupon_code")


# --- a site described by rows -----------------------------------------------------------------------------
_TEMPLATE = (
    ("nova", "card", 1, "section > .offer", None, None), ("nova", "title", 1, "h2.name", None, None), ("nova", "title", 2, "h3", None, None),
    ("nova", "link", 1, "a[href*='/p/']", "href", "absolute:https://nova.example"), ("nova", "price", 1, ".prices > b", None, None),
    ("nova", "original_price", 1, ".prices s", None, None), ("nova", "discount_pct", 1, "[data-off]", "data-off", None),
    ("nova", "coupon_code", 1, "em.coupon", None, None), ("nova", "free_shipping", 1, ".free", None, None))


@query(f"""{OFFERS_SQL} SELECT 'https://nova.example/p/' || oid AS link, title, price_cents / 100.0::DOUBLE AS price, original_cents / 100.0::DOUBLE AS original_price,
  l_linenumber::DOUBLE AS discount_pct, coupon_code, free_shipping FROM offers_v""")
def template_cards(spark, sf):
    """UD2: a new site as a table of rows; all selectors in one walk over each page."""
    card = F.concat(
        F.lit('<div class="offer x">'), F.when(F.col("l_linenumber") % 2 == 0, _tag("h2", F.col("title"), 'class="name"')).otherwise(_tag("h3", F.col("title"))),
        F.lit('<p><a href="/x">no</a><a href="/p/'), F.col("oid"), F.lit('">buy</a></p><div class="prices">'), _tag("s", text.brl(F.col("original_price"))),
        _tag("b", text.brl(F.col("price"))), F.lit('</div><i data-off="-'), F.col("l_linenumber"), F.lit('%">off</i>'),
        F.when(F.col("coupon_code").isNotNull(), _tag("em", F.col("coupon_code"), 'class="coupon"')).otherwise(""),
        F.when(F.col("free_shipping"), '<u class="free">gr&aacute;tis</u>').otherwise(""), F.lit("</div>"))
    pages = _pages(offers_view(spark, sf), "nova", card, "html", "<html><body><section>", "\n", "</section><div class='offer'>no</div></body></html>")
    found = templates.template_cards(pages, spark.createDataFrame(list(_TEMPLATE), templates.TEMPLATES))
    return _numbers(found, "link", "title", "price", "original_price", "discount_pct", "coupon_code", "free_shipping")
