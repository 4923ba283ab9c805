"""Queries over the scalar functions, the quality gate and the score."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.offers_view import ARRIVAL, ARRIVAL_SQL, OFFERS_SQL, offers_view, table
from checks.registry import plain, query
from vitrine import fixed_values as fv
from vitrine.functions import pricing, text, urls
from vitrine.operators import counts, lookup, quality, scoring, tiers
from vitrine.operators.keywords import with_first_rule

VALUE_WORDS = (("widget", 10), ("gizmo", 9), ("gear", 8), ("bolt", 7), ("ring", 6))
LOW_WORDS = ("anvil", "rod")
BLOCKED_WORDS = ("plate", "brand#13")


# --- prices -------------------------------------------------------------------
@query(f"""{OFFERS_SQL} SELECT oid,
  original_cents > price_cents AND price_cents > 0 AS has_discount,
  CASE WHEN original_cents > price_cents AND price_cents > 0 THEN tenths / 10.0::DOUBLE ELSE 5.0::DOUBLE END AS discount,
  CASE WHEN original_cents > price_cents AND price_cents > 0 THEN (original_cents - price_cents) / 100.0::DOUBLE END AS savings,
  CASE WHEN original_cents > price_cents THEN original_cents / 100.0::DOUBLE END AS list_price,
  price_cents / 100.0::DOUBLE AS scaled_price, category AS top_category,
  CASE WHEN price_cents <> 10000 THEN (price_cents - 10000) / 100.0::DOUBLE END AS signed_gap,
  CASE WHEN price_cents > 10000 THEN (price_cents - 10000) / 100.0::DOUBLE END AS positive_gap
  FROM offers_v""")
def offer_metrics(spark, sf):
    """P1, P2, P3, P6, P7, P8, P10, P24."""
    price, listed = F.col("price"), F.col("original_price")
    return plain(offers_view(spark, sf).select(
        "oid", pricing.has_discount(price, listed).alias("has_discount"),
        pricing.calculated_discount(price, listed, F.lit(5.0)).alias("discount"),
        pricing.savings(price, listed).alias("savings"),
        pricing.usable_list_price(price, listed).alias("list_price"),
        pricing.money(pricing.from_scaled((F.col("price_cents") * 1000).cast("string"))).alias("scaled_price"),
        F.substring_index("menu", "/", 1).alias("top_category"),
        pricing.non_zero(price - 100).alias("signed_gap"),
        pricing.positive(price - 100).alias("positive_gap")))


def _sql_brl(amount: str) -> str:
    return f"'R$ ' || translate(format('{{:,.2f}}', CAST({amount} AS DOUBLE)), ',.', '.,')"


@query(f"""{OFFERS_SQL} SELECT oid, {_sql_brl('price')} AS shown, CAST(price AS DOUBLE) AS parsed,
  CAST(price AS DOUBLE) AS from_plain, CAST(price AS DOUBLE) AS from_text,
  CAST(floor(price) AS DOUBLE) AS thousands, CAST(l_linenumber AS DOUBLE) AS percent
  FROM offers_v""")
def parse_price_roundtrip(spark, sf):
    """Format and parse again, in the shapes sources use."""
    shown = text.brl(F.col("price"))
    grouped = F.translate(F.format_number(F.floor("price"), 0), ",", ".")
    return offers_view(spark, sf).select(
        "oid", shown.alias("shown"), text.parse_price(shown).alias("parsed"),
        text.parse_price(F.col("price").cast("string")).alias("from_plain"),
        text.price_in_text(F.concat(F.lit("hoje por "), shown, F.lit(" em 3x"))).alias("from_text"),
        text.parse_price(grouped, thousands_dot=True).alias("thousands"),
        text.percent_in_text(F.concat(F.lit("até "), F.col("l_linenumber"), F.lit(" % OFF"))).alias("percent"))


# --- links ---------------------------------------------------------------------
def _sql_normal(link: str, repair: bool = False) -> str:
    host = f"replace(regexp_extract({link}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), 'www.', '')"
    path = f"regexp_replace(regexp_extract({link}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', '')"
    asked = f"regexp_extract({link}, '^[^?#]*\\?([^#]*)', 1)"
    target = f"{path} || CASE WHEN {asked} <> '' THEN '?' || {asked} ELSE '' END"
    return (f"'https://' || {host} || regexp_replace(regexp_replace({target}, '{fv.LINK_TRACKING}', '', 'g'), "
            f"'[?&]+$', '')")


@query(f"""SELECT page_id, {_sql_normal('url')} AS link, 'promo:' || md5({_sql_normal('url')}) AS link_key FROM pages""")
def link_normalize_pages(spark, sf):
    """P13, P25 over the page addresses."""
    link = urls.normalize_link(F.col("url"))
    return table(spark, sf, "pages").select("page_id", link.alias("link"), urls.link_key(link).alias("link_key"))


@query(f"""{OFFERS_SQL} SELECT oid, norm_link AS link, 'promo:' || md5(norm_link) AS link_key,
  norm_link || '&page=' || l_linenumber AS broken, norm_link || '?page=' || l_linenumber AS repaired FROM offers_v""")
def link_normalize(spark, sf):
    """P13, P25 over the offers; the first parameter takes its question mark along unless repaired."""
    link = urls.normalize_link(F.col("link"))
    paged = F.regexp_replace("link", "&ref=.*", F.concat(F.lit("&page="), F.col("l_linenumber")))
    return offers_view(spark, sf).select(
        "oid", link.alias("link"), urls.link_key(link).alias("link_key"),
        urls.normalize_link(paged).alias("broken"), urls.normalize_link(paged, repair_query=True).alias("repaired"))


@query("""SELECT page_id,
  CASE WHEN regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) = '' THEN url ELSE
    rtrim(regexp_extract(url, '^[^?#]*') || '?' || array_to_string(list_filter(
      string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'),
      lambda p: NOT regexp_matches(lower(p), '^(ref|ref_|tag|aff_id|clickid|social_share)(=|$)')
        AND NOT regexp_matches(lower(p), '^(utm_|cm_sw_)') AND p <> ''), '&'), '?') END AS kept,
  rtrim(regexp_replace(string_split(url, '?')[1], '/+$', ''), '') AS bare
  FROM pages""")
def link_strip_params(spark, sf):
    """P14, P15."""
    return table(spark, sf, "pages").select(
        "page_id", urls.strip_deal_tracking(F.col("url")).alias("kept"), urls.drop_query(F.col("url")).alias("bare"))


@query("SELECT split_part(split_part(url, '://', 2), '/', 1) AS domain, count(*) AS pages FROM pages GROUP BY 1")
def link_domain(spark, sf):
    """P26."""
    return table(spark, sf, "pages").groupBy(urls.url_host(F.col("url")).alias("domain")).agg(
        F.count("*").alias("pages"))


@query(f"""{OFFERS_SQL}, c AS (SELECT *, 'B' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS code FROM offers_v)
  SELECT oid, 'https://www.amazon.com.br/dp/' || code AS canonical, code AS asin, 'MLB' || l_partkey AS listing,
    CAST(l_partkey AS VARCHAR) AS item, CAST(l_suppkey AS VARCHAR) AS shop, CAST(l_partkey AS VARCHAR) AS shop_item,
    'https://cdn.example/img/' || l_partkey || '.jpg' AS image,
    'https://h.example/D-' || l_partkey || '-O.jpg' AS thumbnail,
    CASE WHEN l_linenumber % 3 = 0 THEN true ELSE false END AS good_image,
    l_suppkey % 8 = 3 AS on_shop3,
    CASE WHEN l_returnflag_r THEN 'SAVE' || l_linenumber ELSE norm_link END AS first_filled
  FROM (SELECT *, coupon_code IS NOT NULL AS l_returnflag_r FROM c)""")
def id_and_url_build(spark, sf):
    """P16-P21, F7, F8."""
    from vitrine.sources.common import first_filled
    part = F.col("l_partkey").cast("string")
    code = F.concat(F.lit("B"), F.lpad(part, 9, "0"))
    page = F.concat(F.lit("https://www.amazon.com.br/x/dp/"), code, F.lit("?ref=1&tag=2"))
    pair = F.concat(F.lit("https://shop.example/product/"), F.col("l_suppkey"), F.lit("/"), part)
    shop, item = urls.shop_and_item(pair)
    return offers_view(spark, sf).select(
        "oid", urls.product_page(page).alias("canonical"), urls.product_code(page).alias("asin"),
        urls.listing_code(F.concat(F.lit("https://x.example/MLB-"), part, F.lit("-y"))).alias("listing"),
        urls.item_number(F.concat(F.lit("/item/"), part, F.lit(".html?a=1"))).alias("item"),
        shop.alias("shop"), item.alias("shop_item"),
        urls.absolute(F.concat(F.lit("//cdn.example/img/"), part, F.lit(".jpg")), "https://b").alias("image"),
        urls.original_thumbnail(F.concat(F.lit("https://h.example/D-"), part, F.lit("-I.jpg"))).alias("thumbnail"),
        urls.is_image_url(F.col("image_url")).alias("good_image"),
        urls.on_domain(F.col("link"), "shop3.example").alias("on_shop3"),
        first_filled(F.col("coupon_code"), urls.normalize_link(F.col("link"))).alias("first_filled"))


# --- titles and texts -------------------------------------------------------------
_BLANK = r"[\s\p{Z}]"


def _sql_strip(value: str) -> str:
    return f"regexp_replace({value}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _sql_normal_title(value: str, numbers: bool = True) -> str:
    letters = f"regexp_replace(lower({value}), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', '', 'g')"
    squeezed = _sql_strip(f"regexp_replace({letters}, '{_BLANK}+', ' ', 'g')")
    if not numbers:
        return squeezed
    return _sql_strip(f"regexp_replace({squeezed}, 'r?\\$?{_BLANK}*[0-9]+[.,]?[0-9]*', '', 'g')")


def _sql_clean_title(value: str) -> str:
    done = _sql_strip(f"regexp_replace({value}, '{_BLANK}+', ' ', 'g')")
    for shop in fv.TITLE_STORE_NAMES:
        done = _sql_strip(f"replace({done}, '{shop}', '')")
    pattern = f"[0-9]+{_BLANK}*(min|h|d|dias?|horas?){_BLANK}*[0-9]*{_BLANK}*(min|h|d)?"
    done = f"regexp_replace({done}, '{pattern}', '', 'g')"
    return _sql_strip(f"regexp_replace({done}, '[\\s\\p{{Z}}|–-]+$', '')")


@query(f"""{OFFERS_SQL}, t AS (SELECT oid, 'Amazon ' || title || '  ' || l_linenumber || 'h 30min Shopee |' AS raw FROM offers_v)
  SELECT oid, {_sql_clean_title('raw')} AS cleaned, {_sql_normal_title('raw')} AS normal,
  {_sql_normal_title('raw', False)} AS with_numbers FROM t""")
def title_clean(spark, sf):
    """P11, P12 over offer titles."""
    raw = F.concat(F.lit("Amazon "), F.col("title"), F.lit("  "), F.col("l_linenumber"), F.lit("h 30min Shopee |"))
    return offers_view(spark, sf).select(
        "oid", text.clean_title(raw).alias("cleaned"), text.normalize_title(raw).alias("normal"),
        text.normalize_title(raw, keep_numbers=True).alias("with_numbers"))


@query(f"SELECT doc_id, md5({_sql_normal_title('text')}) AS normal, md5({_sql_clean_title('text')}) AS cleaned FROM documents")
def title_normalize(spark, sf):
    """P11, P12 over whole documents."""
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(text.normalize_title(F.col("text"))).alias("normal"),
        F.md5(text.clean_title(F.col("text"))).alias("cleaned"))


@query(f"""{OFFERS_SQL} SELECT oid,
  CASE WHEN coupon_code IS NOT NULL THEN coupon_code END AS announced, 'OFF' || l_linenumber || 'X' AS labelled,
  'SHARK' || l_partkey AS badge, free_shipping AS ships_free,
  CASE WHEN l_partkey >= 1000 THEN CAST(l_partkey AS VARCHAR) ELSE 'Ative na página' END AS offer_badge FROM offers_v""")
def coupon_from_text(spark, sf):
    """P22, P23."""
    announced = F.concat(F.col("title"), F.coalesce(F.concat(F.lit(" cupom: "), F.lower("coupon_code")), F.lit(" 12345")))
    label = F.concat(F.lit("Leve com cupom off"), F.col("l_linenumber"), F.lit("x hoje"))
    badge = F.concat(F.lit("cupom: shark"), F.col("l_partkey"))
    shipping = F.when(F.col("free_shipping"), "Com Frete Grátis").otherwise("Frete pago")
    return offers_view(spark, sf).select(
        "oid", text.coupon_in_title(announced).alias("announced"),
        F.upper(text.coupon_in_label(label)).alias("labelled"), text.coupon_in_badge(badge).alias("badge"),
        text.mentions_free_shipping(shipping).alias("ships_free"),
        text.coupon_in_offer_badge(F.concat(F.lit("OFF "), F.col("l_partkey"))).alias("offer_badge"))


# --- quality gate --------------------------------------------------------------------
def _first_word(value: str, words) -> str:
    return "CASE " + " ".join(f"WHEN contains({value}, '{w.lower()}') THEN '{w}'" for w in words) + " END"


_PLAIN = r"[\p{L}\p{N} .,/()\[\]!@#$%&*+:;''\"\-]"


def _sql_reason(title, link, price, blocked=fv.BLOCKED_KEYWORDS, blocked_word=None) -> str:
    spam, generic = "|".join(fv.SPAM_PATTERNS), "|".join(fv.GENERIC_PATTERNS)
    blocked_word, poor_word = blocked_word or _first_word(f"lower({title})", blocked), _first_word(f"lower({title})", fv.LOW_QUALITY_WORDS)
    amount = f"printf('%.2f', CAST({price} AS DOUBLE))"
    return f"""CASE WHEN length({_sql_strip(title)}) < 15 THEN 'titulo_curto'
      WHEN {link} IS NULL OR NOT starts_with({link}, 'http') THEN 'link_invalido'
      WHEN {price} < 15 THEN 'preco_baixo (' || {amount} || ')'
      WHEN {price} > 50000 THEN 'preco_alto (' || {amount} || ')'
      WHEN {blocked_word} IS NOT NULL THEN 'palavra_bloqueada (' || {blocked_word} || ')'
      WHEN {poor_word} IS NOT NULL THEN 'baixa_qualidade (' || {poor_word} || ')'
      WHEN regexp_matches({title}, '(?i){spam}') THEN 'spam_detectado'
      WHEN length(regexp_replace({title}, '{_PLAIN}', '', 'g')) > length({title}) * 0.3 THEN 'excesso_caracteres_especiais'
      WHEN regexp_matches({_sql_strip(title)}, '(?i){generic}') THEN 'titulo_generico' END"""


_REASON = _sql_reason("title", "link", "price", BLOCKED_WORDS)


@query(f"{OFFERS_SQL} SELECT oid, {_REASON} AS reason FROM offers_v")
def quality_reasons(spark, sf):
    """F2 with its details."""
    return quality.quality_gate(offers_view(spark, sf), blocked=BLOCKED_WORDS).select("oid", "reason")


_DOC_LINK = "CASE WHEN doc_id % 7 = 0 THEN 'ftp://x' ELSE 'https://x' END"
_DOC_PRICE = "CAST(n_chars AS DOUBLE)"


@query(f"SELECT doc_id, {_sql_reason('text', _DOC_LINK, _DOC_PRICE)} AS reason FROM documents")
def quality_reasons_documents(spark, sf):
    """F2 over whole document texts as titles, with default word lists."""
    return table(spark, sf, "documents").select("doc_id", quality.refusal_reason(
        F.col("text"), F.expr(_DOC_LINK), F.expr(_DOC_PRICE)).alias("reason"))


@query(f"""{OFFERS_SQL}, g AS (SELECT {_REASON} AS reason FROM offers_v)
  SELECT count(*) AS total_processed, count(*) FILTER (reason IS NULL) AS passed,
  count(*) FILTER (reason IS NOT NULL) AS filtered,
  printf('%.1f%%', count(*) FILTER (reason IS NULL) / count(*)::DOUBLE * 100) AS pass_rate FROM g""")
def quality_funnel(spark, sf):
    """A4, P35."""
    return counts.quality_funnel(quality.quality_gate(offers_view(spark, sf), blocked=BLOCKED_WORDS))


@query(f"""{OFFERS_SQL}, g AS (SELECT {_REASON} AS reason FROM offers_v)
  SELECT regexp_extract(reason, '^[a-z_]+') AS reason_code, count(*) AS offers FROM g WHERE reason IS NOT NULL GROUP BY 1""")
def quality_refusals(spark, sf):
    """A10."""
    return counts.refusals(quality.quality_gate(offers_view(spark, sf), blocked=BLOCKED_WORDS))


@query(f"""{OFFERS_SQL} SELECT oid FROM offers_v WHERE l_linenumber <> 3 AND starts_with(link, 'http') AND price > 0""")
def valid_records(spark, sf):
    """every third line has a title below the limit."""
    title = F.when(F.col("l_linenumber") == 3, "  too few ").otherwise(F.col("title"))
    return offers_view(spark, sf).filter(
        quality.is_valid_record(title, F.col("link"), F.col("price"))).select("oid")


_TERMS = "|".join(t.replace("-", "\\-") for t in fv.DIGITAL_TERMS)


@query(f"""{OFFERS_SQL}, d AS (SELECT *, title || CASE WHEN l_linenumber = 1 THEN ' Blu-ray' WHEN l_linenumber = 2 THEN ' Série' ELSE '' END AS t FROM offers_v)
  SELECT oid, regexp_matches(lower(t || ' ' || link), '{_TERMS}') AS digital,
  coalesce(tenths, 0) >= 250 AS real_discount, l_linenumber <> 3 AS active FROM d""")
def digital_filter(spark, sf):
    """F3, F4, F5."""
    longer = F.concat(F.col("title"), F.when(F.col("l_linenumber") == 1, " Blu-ray").when(
        F.col("l_linenumber") == 2, " Série").otherwise(""))
    status = F.when(F.col("l_linenumber") == 3, "expired").when(F.col("l_linenumber") == 4, "").when(
        F.col("l_linenumber") == 5, "active")
    return offers_view(spark, sf).select(
        "oid", quality.is_digital(longer, F.col("link")).alias("digital"),
        quality.real_discount(F.col("price"), F.col("original_price"), F.lit(None).cast("double"), 25).alias("real_discount"),
        quality.is_active(status).alias("active"))


# --- score ------------------------------------------------------------------------------
def _sql_score() -> str:
    weight = "CASE " + " ".join(f"WHEN contains(lower(title), '{k}') THEN {w}" for k, w in VALUE_WORDS) + " ELSE 0 END"
    low = " OR ".join(f"contains(lower(title), '{w}')" for w in LOW_WORDS)
    return f"""CAST(least(100, greatest(0,
      CASE WHEN price = 0 THEN 0 WHEN price > 2000 THEN 40 WHEN price > 1000 THEN 35 WHEN price > 500 THEN 25
        WHEN price > 100 THEN 15 WHEN price < 10 THEN -20 ELSE 0 END
      + CASE WHEN coalesce(tenths, 0) = 0 THEN 0 WHEN tenths >= 500 THEN 30 WHEN tenths >= 300 THEN 20
        WHEN tenths >= 150 THEN 10 WHEN tenths < 50 THEN -10 ELSE 0 END
      + 2 * {weight} - CASE WHEN {low} THEN 30 ELSE 0 END
      + CASE WHEN coupon_code IS NOT NULL THEN 7 ELSE 0 END + CASE WHEN free_shipping THEN 3 ELSE 0 END
      - CASE WHEN length(title) BETWEEN 15 AND 200 THEN 0 ELSE 15 END
      - CASE WHEN contains(title, '???') OR contains(title, '!!!') THEN 10 ELSE 0 END)) AS DOUBLE)"""


SCORED_SQL = f"{OFFERS_SQL}, scored AS (SELECT *, {_sql_score()} AS score FROM offers_v)"


def scored_offers(spark, sf):
    return scoring.score(offers_view(spark, sf), value_keywords=VALUE_WORDS, low_value=LOW_WORDS)


@query(f"{SCORED_SQL} SELECT oid, score FROM scored")
def score_offers(spark, sf):
    """S1, W4."""
    return scored_offers(spark, sf).select("oid", "score")


@query(f"{SCORED_SQL} SELECT oid, store, score FROM scored WHERE score >= 15 ORDER BY score DESC, {ARRIVAL_SQL} LIMIT 10")
def score_top10(spark, sf):
    """The best offers of one batch."""
    return scoring.best_offers(scored_offers(spark, sf), ARRIVAL).select("oid", "store", "score")


@query(f"""{SCORED_SQL} SELECT oid, store, score FROM scored WHERE score >= 15
  QUALIFY row_number() OVER (PARTITION BY store ORDER BY score DESC, {ARRIVAL_SQL}) <= 10""")
def score_top10_per_store(spark, sf):
    """L2 per store."""
    top = tiers.cap_per_group(scored_offers(spark, sf), ["store"], [F.col("score").desc(), *ARRIVAL], 10)
    return scoring.worth_showing(top).select("oid", "store", "score")


# --- small lists ---------------------------------------------------------------------------
@query(f"""{OFFERS_SQL} SELECT oid, {_first_word('lower(title)', [w for w, _ in VALUE_WORDS])} AS keyword FROM offers_v""")
def keyword_first_match(spark, sf):
    """J4, W4, SC20: the word list comes as a table read from comma-separated text."""
    listed = spark.range(1).select(F.posexplode(text.text_list(F.lit(" widget, gizmo,,gear ,bolt, ring,"))).alias("priority", "keyword"))
    rules = listed.select(F.lit("value").alias("rule_set"), "keyword", F.lit(1).alias("weight"), "priority")
    offers = offers_view(spark, sf).select("oid", F.lower("title").alias("lowered"))
    return with_first_rule(offers, lookup.load_rules(rules, "value"), "lowered", "rule").select("oid", "rule.keyword")


_PART_RULES = """SELECT lower(p_name || ' ' || p_brand) AS keyword, min(p_partkey) AS priority FROM part WHERE p_size % 7 = 0 GROUP BY 1"""


@query(f"""{OFFERS_SQL}, rules AS ({_PART_RULES}),
  hit AS (SELECT title, arg_min(keyword, priority) AS word FROM (SELECT DISTINCT title FROM offers_v) JOIN rules ON contains(lower(title), keyword) GROUP BY 1)
  SELECT oid, {_sql_reason('o.title', 'link', 'price', blocked_word='word')} AS reason FROM offers_v o LEFT JOIN hit ON hit.title = o.title""")
def quality_reasons_by_table(spark, sf):
    """J4, F2.4: a list of blocked names that is a table, a seventh of all parts long."""
    names = table(spark, sf, "part").filter("p_size % 7 = 0").select(
        F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("keyword"), F.col("p_partkey").alias("priority"))
    return quality.quality_gate(offers_view(spark, sf), blocked=names).select("oid", "reason")


@query(f"""{OFFERS_SQL}, words AS (SELECT lower(p_type) AS keyword, min(p_partkey) AS priority FROM part GROUP BY 1),
  rules AS (SELECT keyword, priority, priority % 11 AS weight FROM words),
  hit AS (SELECT title, arg_min(weight, priority) AS points FROM (SELECT DISTINCT title FROM offers_v) JOIN rules ON contains(lower(title), keyword) GROUP BY 1)
  SELECT oid, coalesce(points, 0) * 2 AS keyword_points FROM offers_v o LEFT JOIN hit ON hit.title = o.title""")
def score_keywords_by_table(spark, sf):
    """The weights of all part types as a table."""
    words = table(spark, sf, "part").groupBy(F.lower("p_type").alias("keyword")).agg(F.min("p_partkey").alias("priority"))
    scored = scoring.score_parts(offers_view(spark, sf), value_keywords=words.withColumn("weight", F.col("priority") % 11))
    return scored.select("oid", F.col("parts.keyword").alias("keyword_points"))


def _sql_choose(value: str, pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {value.format(k)} THEN '{v}'" for k, v in pairs) + f" ELSE {default} END"


_NAME = _sql_choose("store = '{}'", [(k, n) for k, (n, _) in fv.STORES.items()], "store")
_MARKER = _sql_choose("store = '{}'", [(k, m) for k, (_, m) in fv.STORES.items()], f"'{fv.DEFAULT_MARKER}'")
_ORIGIN = _sql_choose("contains(lower(origin), '{}')", fv.ORIGIN_MARKERS, f"'{fv.DEFAULT_MARKER}'")
_FOREIGN = "store IN ('pelando', 'promobit') AND origin <> ''"
SHOWN_NAME = f"CASE WHEN {_FOREIGN} THEN origin ELSE {_NAME} END"
SHOWN_MARKER = f"CASE WHEN {_FOREIGN} THEN {_ORIGIN} ELSE {_MARKER} END"


@query(f"{OFFERS_SQL} SELECT oid, {SHOWN_NAME} AS shown_store, {SHOWN_MARKER} AS marker FROM offers_v")
def origin_lookup(spark, sf):
    """J6, J7, P28."""
    name, marker = lookup.shown_store(F.col("store"), F.col("origin"))
    return offers_view(spark, sf).select("oid", name.alias("shown_store"), marker.alias("marker"))
