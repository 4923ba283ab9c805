from decimal import Decimal

from pyspark.sql import functions as F

from vitrine.functions import pricing, text, urls
from vitrine.operators.render import caption


def test_price_text(values):
    assert values(text.parse_price, "R$ 1.299,90", "1.299", "1.2.3", "", "10", "1,299.90", "-5", "R$ 10,00 - R$ 20,00") == [
        1299.9, 1.299, None, None, 10.0, 1.2999, 5.0, None]
    assert values(lambda c: text.parse_price(c, True), "1.299", "12.50", "1.299.000") == [1299.0, 12.5, 1299000.0]
    assert values(text.price_in_text, "por R$ 1.234,56 hoje", "R$ 10") == [1234.56, None]
    assert values(text.brl, Decimal("1299.90"), Decimal("10"), Decimal("0.99"), kind="decimal(12,2)") == [
        "R$ 1.299,90", "R$ 10,00", "R$ 0,99"]


def test_titles(values):
    assert values(text.clean_title, "SSD  Kingston Amazon 1TB 5h 30min - ", "Monitor 144hz", "oferta 5 dias") == [
        "SSD Kingston  1TB", "Monitor z", "oferta ias"]
    assert values(text.normalize_title, "RTX 4060: Promoção!", "RTX 4070 promoção", "!!!") == [
        "rtx promoção", "rtx promoção", ""]
    assert values(lambda c: text.normalize_title(c, True), "RTX 4060!") == ["rtx 4060"]


def test_coupons(values):
    assert values(text.coupon_in_title, "Use o CUPOM: SHARK20 hoje", "cupom 12345", "nada", "COD ABC1") == [
        "SHARK20", None, None, "ABC1"]
    assert values(text.coupon_in_label, "CUPOM SHARK15", "tem cupom", "novo") == ["SHARK15", "tem cupom", None]
    assert values(text.coupon_in_badge, "Cupom: shark20", "ok", "desconto") == ["SHARK20", None, "desconto"]
    assert values(text.coupon_in_offer_badge, "30% off", "cupom ABCD", "nada") == ["Ative na página", "CUPOM", None]


def test_links(values):
    assert values(urls.normalize_link, "http://www.a.com/p/?utm_source=x&b=2&ref=3#f", "https://A.com/x?b=1&ref=2", "https://a.com/x?ref_=1") == [
        "https://a.com/p&b=2", "https://A.com/x?b=1", "https://a.com/x?ref_=1"]
    assert values(lambda c: urls.normalize_link(c, True), "http://www.a.com/p/?utm_source=x&b=2") == ["https://a.com/p?b=2"]
    dirty = "https://www.amazon.com.br/dp/B0CCBGXKLP?ref=cm_sw_r_cso&utm_source=p&social_share=abc&psc=1"
    assert values(urls.strip_deal_tracking, dirty) == ["https://www.amazon.com.br/dp/B0CCBGXKLP?psc=1"]
    assert values(urls.product_page, "https://www.amazon.com.br/dp/B08GLX7TNT?ref=d&tag=x", "https://x/gp/product/B08GLX7TNT?ref=x") == [
        "https://www.amazon.com.br/dp/B08GLX7TNT", "https://x/gp/product/B08GLX7TNT"]
    assert values(urls.is_image_url, "https://x/a.jpg", "", "not-a-url", "data:image/png;base64", "https://x/placeholder.jpg", None) == [
        True, False, False, False, False, False]


def test_normal_forms_are_stable(values):
    titles = ["RTX 4060: Promoção!", "  A  b 12,5 c", "r$ 10", "ÀÉ ô_x"]
    once = values(text.normalize_title, *titles)
    assert values(text.normalize_title, *once) == once
    links = ["http://www.a.com/p/?b=2#f", "https://a.com", "https://a.com/x?y=1&z=2"]
    once = values(urls.normalize_link, *links)
    assert values(urls.normalize_link, *once) == once


def test_discounts(spark):
    rows = spark.createDataFrame(
        [(1, 100.0, 150.0, None), (2, 100.0, 90.0, 7.0), (3, None, 90.0, None), (4, 0.0, 10.0, None), (5, 399.9, 549.9, None)],
        "i int, p double, o double, d double")
    p, o, d = F.col("p"), F.col("o"), F.col("d")
    got = rows.orderBy("i").select(
        pricing.has_discount(p, o), pricing.calculated_discount(p, o, d), pricing.savings(p, o),
        pricing.usable_list_price(p, o)).collect()
    assert [tuple(r) for r in got] == [
        (True, Decimal("33.3"), Decimal("50.00"), 150.0), (False, Decimal("7.0"), None, None),
        (False, None, None, 90.0), (False, None, None, 10.0), (True, Decimal("27.3"), Decimal("150.00"), 549.9)]


def test_caption_limit(values):
    short, long = values(caption, "x" * 1024, "x" * 2000)
    assert len(short) == 1024 and len(long) == 1024 and long.endswith("\n...")
