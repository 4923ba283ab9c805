from pyspark.sql import functions as F

from vitrine.operators import quality, scoring

SCHEMA = "i int, title string, link string, price double, original_price double, discount_pct double, coupon_code string, free_shipping boolean"
LONG = "Um titulo qualquer"


def offers(spark, *rows):
    base = {"title": LONG, "link": "https://x", "price": 50.0, "original_price": None, "discount_pct": None,
            "coupon_code": None, "free_shipping": False}
    return spark.createDataFrame([(i, *{**base, **r}.values()) for i, r in enumerate(rows)], SCHEMA)


def test_reasons(spark):
    rows = offers(
        spark, {}, {"title": "x" * 14}, {"title": "x" * 15}, {"link": "ftp://x"}, {"link": None}, {"price": 14.99},
        {"price": 15.0}, {"price": 50000.01}, {"price": None}, {"title": "Capinha para celular"},
        {"title": "Amostra grátis de tudo"}, {"title": "calcinha bonita azul"}, {"title": "Produto ESGOTADO agora"},
        {"title": "ª§¨~^°¬¢ abc ¨~^°¬¢"}, {"title": "PROMOÇÃO      1234567"}, {"title": "R$ 1.234,56 7890 000"}, {"price": 0.0})
    got = [r.reason for r in quality.quality_gate(rows).orderBy("i").collect()]
    assert got == [
        None, "titulo_curto", None, "link_invalido", "link_invalido", "preco_baixo (14.99)", None,
        "preco_alto (50000.01)", None, "palavra_bloqueada (capinha)", "palavra_bloqueada (amostra)",
        "baixa_qualidade (calcinha)", "spam_detectado", "excesso_caracteres_especiais", "titulo_generico",
        "titulo_generico", "preco_baixo (0.00)"]
    open_gate = quality.quality_gate(rows, blocked=[]).orderBy("i").collect()
    assert open_gate[9].reason == "baixa_qualidade (capinha)"
    passed = sum(r is None for r in got)
    assert passed + sum(r is not None for r in got) == rows.count()


def points(spark, *rows):
    return [r.score for r in scoring.score(offers(spark, *rows)).orderBy("i").collect()]


def test_price_and_discount_bands(spark):
    base = 100.0  # keeps totals off the clamp: 40 from a price above 2000 is added to each discount case
    assert points(spark, *[{"price": p} for p in (2000.01, 2000.0, 1000.0, 500.0, base, 10.0)]) == [40, 35, 25, 15, 0, 0]
    assert points(spark, *[{"price": 3000.0, "discount_pct": d} for d in (50.0, 49.9, 30.0, 15.0, 14.9, 5.0, 4.9, 0.0)]) == [
        70, 60, 60, 50, 40, 40, 30, 40]


def test_words_extras_and_penalties(spark):
    assert points(
        spark, {"price": 3000.0, "title": "Monitor com notebook x"}, {"price": 3000.0, "title": "controle com capinha xx"},
        {"price": 3000.0, "coupon_code": "A", "free_shipping": True}, {"price": 3000.0, "coupon_code": ""},
        {"price": 3000.0, "title": "curto"}, {"price": 3000.0, "title": "x" * 200}, {"price": 3000.0, "title": "x" * 201},
        {"price": 3000.0, "title": LONG + "!!!"}, {"price": 5.0}, {"price": 3000.0, "discount_pct": 60.0, "title": "notebook gamer novo", "coupon_code": "A", "free_shipping": True},
    ) == [60, 24, 50, 40, 25, 40, 25, 30, 0, 100]


def test_ranking(spark):
    rows = offers(spark, {"price": 600.0}, {"price": 3000.0}, {"price": 50.0}, {"price": 700.0})
    best = scoring.best_offers(scoring.score(rows), ["i"], wanted=20)
    assert [r.i for r in best.collect()] == [1, 0, 3]
    assert scoring.best_offers(scoring.score(rows), ["i"], wanted=1).count() == 1


def test_predicates(values, spark):
    one = spark.range(1)
    digital = lambda t, l: one.select(quality.is_digital(F.lit(t), F.lit(l))).first()[0]
    assert digital("A Casa do Dragão - 2ª Temporada (Prime Video)", "https://x")
    assert not digital("SSD Samsung 980 Pro 1TB NVMe PCIe", "https://www.amazon.com.br/dp/B08GLX7TNT")
    real = lambda *v: one.select(quality.real_discount(*[F.lit(x).cast("double") for x in v])).first()[0]
    assert real(100, 150, None) and not real(100, 103, None) and not real(100, None, None) and real(100, None, 10)
    assert values(quality.is_active, "active", "", None, "expired") == [True, True, True, False]
