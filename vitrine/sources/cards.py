"""SC13-SC18: offers from HTML cards and links.

Each site says which nodes are cards and, per field, which selectors to try in order; one walk over a page reads them all
(``card_reader``). A card is then a row of texts, and what they mean are Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import pricing, text, urls
from vitrine.functions.html import first_value, page_nodes
from vitrine.operators.quality import is_digital, real_discount
from vitrine.sources.card_reader import Read, Site, read_cards
from vitrine.sources.common import computed, item_rows, offer, offer_rows, text_map

ENOUGH_CARDS = 3


def with_nodes(pages: DataFrame) -> DataFrame:
    return pages.withColumn("nodes", page_nodes("body"))


def _price(raw: Column) -> Column:
    price = text.parse_price(raw)
    return F.when(price > 0, price)


def _first_attr(attr: str, *selectors: str, root: str = "card") -> Read:
    return Read(selectors, (attr,), root=root)


def _texts(*selectors: str, of: str = "text") -> Read:
    return Read(selectors, of, "all")


_IMAGE = ("src", "data-src")
Fields = dict[str, Column]


def _read(pages: DataFrame, site: Site, most: int | None, fields: Callable[[Column], Fields], build: Callable[[Column], Column],
          tier: int) -> DataFrame:
    """Offers of the site's cards: ``fields`` are worked out once per card, ``build`` makes the offer from them."""
    cards = item_rows(pages, read_cards(site, F.col("body"), most))
    ready = computed(cards, F.struct(*[value.alias(f"f_{name}") for name, value in fields(F.col("item")).items()]))
    return offer_rows(ready, build(_Columns()), tier).filter("key is not null")


class _Columns:
    def __getitem__(self, name: str) -> Column:
        return F.col(f"f_{name}")


# --- SC13 --------------------------------------------------------------------
AMAZON = Site(
    cards=("[data-component-type=s-search-result]", "[data-asin][data-index]", ".DealCard-module__dealCard_1MCGB",
           ".a-section.octopus-dlp-asin-section", ".s-result-item[data-asin]", "li[data-asin]", "div[data-asin]"),
    fields={
        "own_code": Read(of=("data-asin",)),
        "href": _first_attr("href", "a[href*='/dp/'], a[href*='/gp/product/']"),
        "title": Read(("h2 a span", "h2 span", ".a-size-medium", ".a-size-base-plus", "[class*=title]", ".a-text-normal", "h2"), pick="long"),
        "whole": Read((".a-price-whole",)), "cents": Read((".a-price-fraction",)),
        "prices": _texts(".a-price[data-a-size=xl] .a-offscreen", ".a-price[data-a-size=l] .a-offscreen", ".a-price .a-offscreen", ".a-price-whole"),
        "listed": _texts(".a-text-price .a-offscreen", ".a-text-strike", ".a-price.a-text-price span"),
        "percents": _texts(".a-size-base.a-color-price", "[class*=savingsPercentage]", ".a-color-price", ".badge-savings", of="raw"),
        "coupons": _texts(".a-badge-text", "[class*=coupon]", ".a-color-success", "[class*=voucher]"),
        "ships_free": Read((".a-color-success, [class*=freeShipping], [class*=free-shipping]",), "place"),
        "image": Read(("img[src]",), _IMAGE), "all_text": Read(of="spaced"),
    })


def amazon_cards(pages: DataFrame, tier: int = 1, most: int | None = 40) -> DataFrame:
    def fields(c: Column) -> Fields:
        code = F.coalesce(text.non_empty(c["own_code"]), urls.product_code(c["href"]))
        from_parts = text.parse_price(F.concat(
            F.translate(c["whole"], ".,", ""), F.coalesce(F.concat(F.lit(","), c["cents"]), F.lit(""))))
        return {
            "code": code, "link": F.concat(F.lit("https://www.amazon.com.br/dp/"), code), "title": c["title"],
            "cleaned": text.clean_title(c["title"]), "price": F.coalesce(first_value(c["prices"], _price), from_parts),
            "listed": first_value(c["listed"], _price), "percent": first_value(c["percents"], text.percent_in_text),
            "coupon": first_value(c["coupons"], text.coupon_in_offer_badge), "image": c["image"],
            "ships_free": c["ships_free"].isNotNull() | text.mentions_free_shipping(c["all_text"], ("frete grátis", "entrega grátis"))}

    def built(f) -> Column:
        return offer(
            key=f["link"], title=f["cleaned"], link=f["link"],
            ok=(F.length(f["title"]) >= 10) & ~is_digital(f["cleaned"], f["link"]),
            price=f["price"], original_price=pricing.usable_list_price(f["price"], f["listed"]),
            discount_pct=f["percent"], image_url=urls.larger_image(f["image"]), coupon_code=f["coupon"],
            free_shipping=f["ships_free"], extra=text_map(asin=f["code"], source=F.lit("html_card")))

    return _read(pages, AMAZON, most, fields, built, tier).filter("ok")


# --- SC14 --------------------------------------------------------------------
_AMOUNT = ".andes-money-amount__fraction"
MERCADOLIVRE = Site(
    cards=(".andes-card.poly-card", "[class*=poly-card]", ".promotion-item", ".ui-search-result", "li[class*=result]"),
    fields={
        "href": _first_attr("href", "a[href]"),
        "title": Read(("[class*=title]", ".poly-component__title", ".promotion-item__title", "h2", "h3"), pick="long"),
        "prices": _texts(_AMOUNT, ".price-tag-fraction", "[class*=price] .fraction"),
        "listed": _texts(f".andes-money-amount--previous {_AMOUNT}", ".price-tag-amount-saved", f"s {_AMOUNT}"),
        "percent": Read((".andes-money-amount__discount, [class*=discount]",), "raw"),
        "image": Read(("img[src], img[data-src]",), _IMAGE),
    })


def mercadolivre_cards(pages: DataFrame, tier: int = 1, most: int | None = 25) -> DataFrame:
    def fields(c: Column) -> Fields:
        return {
            "code": urls.listing_code(c["href"]), "href": c["href"], "title": text.clean_title(text.non_empty(c["title"])),
            "price": first_value(c["prices"], _price), "listed": first_value(c["listed"], _price),
            "percent": text.percent_in_text(c["percent"]), "image": c["image"]}

    def built(f) -> Column:
        return offer(
            key=f["code"], title=f["title"], link=urls.drop_query(f["href"]),
            ok=urls.on_domain(f["href"], "mercadolivre.com.br") & real_discount(f["price"], f["listed"], f["percent"]),
            price=f["price"], original_price=f["listed"], discount_pct=f["percent"],
            image_url=f["image"], extra=text_map(ml_id=f["code"], source=F.lit("html")))

    return _read(pages, MERCADOLIVRE, most, fields, built, tier).filter("ok")


# --- SC15 --------------------------------------------------------------------
TERABYTE = Site(
    cards=(".p-card", ".product-item", ".commerce_columns_item_inner", ".p-container", ".pbox", "div[class*=product]", "a[href*='/produto/']"),
    link="a[href*='/produto/']",
    fields={
        "href": _first_attr("href", root="link"), "link_title": _first_attr("title", root="link"), "link_text": Read(root="link"),
        "title": Read((".prod-name", ".product-name", ".p-title", "[class*=prod-name]", "[class*=title]", "h2", "h3", "h4"), pick="long"),
        "prices": _texts(".prod-new-price span", ".prod-new-price", ".val-prod", ".price-new", "[class*=price-new]", "[class*=new-price]", ".destaque"),
        "listed": _texts(".prod-old-price span", ".prod-old-price", "strike", "s", "[class*=old-price]", "[class*=price-old]"),
        "badges": _texts(".prod-discount", ".p-discount", "[class*=discount]", ".badge-desconto", of="raw"),
        "coupons": _texts("[class*=coupon]", "[class*=cupom]", ".badge-cupom"),
        "lazy": _first_attr("data-src", "img[data-src]"), "src": _first_attr("src", "img[src]"), "original": _first_attr("data-original", "img[data-original]"),
        "all_text": Read(of="spaced"),
    })


def terabyte_cards(pages: DataFrame, tier: int = 0, most: int | None = 35) -> DataFrame:
    base = "https://www.terabyteshop.com.br"

    def fields(c: Column) -> Fields:
        href = c["href"]
        full = F.when(href.startswith("http"), href).when(href.startswith("/"), F.concat(F.lit(base), href))
        return {
            "link": urls.drop_query(full, drop_slash=False),
            "title": F.coalesce(text.non_empty(c["title"]), text.non_empty(c["link_title"]), c["link_text"]),
            "price": first_value(c["prices"], _price), "listed": first_value(c["listed"], _price),
            "badge": first_value(c["badges"], text.percent_in_text), "coupon": first_value(c["coupons"], text.coupon_in_badge),
            "image": F.coalesce(*[F.when((p != "") & ~p.startswith("data:"), urls.absolute(p, base))
                                  for p in (c["lazy"], c["src"], c["original"])]),
            "ships_free": text.mentions_free_shipping(c["all_text"], ("frete grátis", "frete gratis"))}

    def built(f) -> Column:
        return offer(
            key=f["link"], title=text.clean_title(f["title"]), link=f["link"],
            ok=F.length(f["title"]) >= 10, price=f["price"], original_price=pricing.usable_list_price(f["price"], f["listed"]),
            discount_pct=F.coalesce(f["badge"], F.when(
                f["listed"] > f["price"], pricing.percent_off(f["price"], f["listed"]).cast("double"))),
            image_url=f["image"], coupon_code=f["coupon"], free_shipping=f["ships_free"], extra=text_map(source=F.lit("terabyte_html")))

    return _read(pages, TERABYTE, most, fields, built, tier).filter("ok")


# --- SC16 --------------------------------------------------------------------
SHOPEE = Site(
    cards=("[class*=flash-sale-item], [class*=FlashSaleItem], [class*=product-item], .shopee-flash-sale-products__product-card",),
    fields={
        "href": _first_attr("href", "a[href]"), "title": Read(("[class*=name], [class*=title], h2, h3",)),
        "price": Read(("[class*=price]",)), "image": _first_attr("src", "img[src]"),
    })


def shopee_cards(pages: DataFrame, tier: int = 2, most: int | None = 30) -> DataFrame:
    def fields(c: Column) -> Fields:
        href = c["href"]
        full = F.when(href.startswith("http"), href).otherwise(F.concat(F.lit("https://shopee.com.br"), href))
        shop_id, item_id = urls.shop_and_item(full)
        return {"link": full, "shop_id": shop_id, "item_id": item_id, "title": text.clean_title(text.non_empty(c["title"])),
                "price": text.parse_price(c["price"]), "image": c["image"]}

    def built(f) -> Column:
        return offer(
            key=f["item_id"], title=f["title"], link=f["link"], price=f["price"], image_url=f["image"],
            extra=text_map(shop_id=f["shop_id"], item_id=f["item_id"], source=F.lit("shopee_html")))

    return _read(pages, SHOPEE, most, fields, built, tier).filter("ok")


# --- SC17 --------------------------------------------------------------------
PROMOBIT = Site(
    cards=("div[class*=OfferCard]", "article[class*=OfferCard]", ".offer-card", "a[href*='/oferta/']"), enough=1, link="a[href*='/oferta/']",
    fields={
        "href": _first_attr("href", root="link"), "title": Read(("h2, h3, [class*=title], [class*=Title]",)),
        "price": Read(("[class*=price], [class*=Price]",)), "shop": Read(("[class*=retailer], [class*=store], [class*=Retailer]",)),
        "image": Read(("img[src], img[data-src]",), _IMAGE),
    })


def promobit_cards(pages: DataFrame, tier: int = 2, most: int | None = 30) -> DataFrame:
    def fields(c: Column) -> Fields:
        href = text.non_empty(c["href"])
        return {"link": F.when(href.startswith("/"), F.concat(F.lit("https://www.promobit.com.br"), href)).otherwise(href),
                "title": text.clean_title(text.non_empty(c["title"])), "price": text.parse_price(c["price"]), "shop": c["shop"],
                "image": c["image"]}

    def built(f) -> Column:
        return offer(
            key=f["link"], title=f["title"], link=f["link"], price=f["price"], image_url=f["image"],
            extra=text_map(origin_store=f["shop"], source=F.lit("promobit_html")))

    return _read(pages, PROMOBIT, most, fields, built, tier)


# --- SC18 --------------------------------------------------------------------
DEALS = Site(
    cards=("a[href*='/d/']",),
    fields={"href": Read(of=("href",)), "own": Read(), "beside": Read(of="beside"), "image": Read(("img",), _IMAGE)})


def deal_links(pages: DataFrame, tier: int = 2) -> DataFrame:
    """Links to deal pages; a short link text gives way to a longer text beside it."""
    def fields(c: Column) -> Fields:
        href, title = c["href"], F.when(F.length(c["own"]) < 15, c["beside"]).otherwise(c["own"])
        return {"link": F.when(href.startswith("http"), href).otherwise(F.concat(F.lit("https://www.pelando.com.br"), href)),
                "title": title, "image": c["image"]}

    def built(f) -> Column:
        return offer(
            key=f["link"], title=text.clean_title(f["title"]), link=f["link"], ok=F.length(f["title"]) >= 10,
            price=text.price_in_text(f["title"]), image_url=f["image"], extra=text_map(source=F.lit("pelando_html")))

    return _read(pages, DEALS, None, fields, built, tier).filter("ok")


ITEMS = Site(
    cards=("a[href*='/item/']",),
    fields={
        "href": Read(of=("href",)), "own": Read(), "near": Read(("[class*=title], [class*=name], h3, h4",), root="parent"),
        "price": Read(("[class*=price], [class*=Price]",), root="around"), "image": _first_attr("src", "img[src]", root="around"),
    })


def item_links(pages: DataFrame, tier: int = 1, most: int | None = 20) -> DataFrame:
    """Links to item pages; price and picture come from the card around the link."""
    def fields(c: Column) -> Fields:
        return {"number": urls.item_number(c["href"]),
                "title": F.when(F.length(c["own"]) < 10, F.coalesce(c["near"], c["own"])).otherwise(c["own"]),
                "price": text.parse_price(c["price"]), "image": c["image"]}

    def built(f) -> Column:
        image = f["image"]
        return offer(
            key=f["number"], title=text.clean_title(f["title"]), ok=F.length(f["title"]) >= 10,
            link=F.concat(F.lit("https://pt.aliexpress.com/item/"), f["number"], F.lit(".html")),
            price=f["price"], image_url=F.when(image.startswith("http") | (image == ""), image).otherwise(
                F.concat(F.lit("https:"), image)),
            extra=text_map(ali_id=f["number"]))

    return _read(pages, ITEMS, most, fields, built, tier).filter("ok")
