"""Queries over duplicates, history, reports, unions and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.offers_view import ARRIVAL, ARRIVAL_SQL, OFFERS_SQL, STORES, offers_view, table
from checks.registry import plain, query
from checks.scalar_queries import (
    _REASON, BLOCKED_WORDS, LOW_WORDS, SCORED_SQL, VALUE_WORDS, scored_offers,
)
from vitrine.functions.similarity import title_ratio
from vitrine.functions.text import normalize_title
from vitrine.functions.urls import normalize_link
from vitrine.operators import counts, dedup, history, lookup, quality, tiers, titles
from vitrine.operators.greedy import first_wins
from vitrine.plans import reports
from vitrine.plans.cycle import CycleOptions, run_cycle

HISTORY_END = "1998-01-01"


def normalized(spark, sf):
    return offers_view(spark, sf).withColumn("link", normalize_link(F.col("link")))


def events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "key", F.concat_ws("|", "user_id", "event_type"))


# --- duplicates -------------------------------------------------------------------
@query(f"{OFFERS_SQL} SELECT oid, norm_link AS link FROM offers_v QUALIFY row_number() OVER (PARTITION BY norm_link ORDER BY {ARRIVAL_SQL}) = 1")
def dedup_link_first(spark, sf):
    """W1, W2."""
    return tiers.keep_first(normalized(spark, sf), ["link"], ARRIVAL).select("oid", "link")


@query(f"""{OFFERS_SQL} SELECT oid FROM offers_v WHERE l_shipdate >= '{HISTORY_END}' AND norm_link NOT IN
  (SELECT norm_link FROM offers_v WHERE l_shipdate < '{HISTORY_END}')""")
def dedup_history_anti(spark, sf):
    """Later offers never published before."""
    offers = normalized(spark, sf)
    sent = offers.filter(f"l_shipdate < '{HISTORY_END}'")
    return dedup.unpublished(offers.filter(f"l_shipdate >= '{HISTORY_END}'"), sent).select("oid")


_TTL_DAYS = 60


@query(f"""{OFFERS_SQL} SELECT oid FROM offers_v o WHERE NOT EXISTS (SELECT 1 FROM offers_v s
  WHERE s.coupon_code IS NOT NULL AND s.norm_link = o.norm_link AND s.collected_at < o.collected_at
  AND s.collected_at >= o.collected_at - INTERVAL {_TTL_DAYS} DAY)""")
def dedup_ttl_anti(spark, sf):
    """Offers whose link had no coupon offer in the days before."""
    offers = normalized(spark, sf)
    seen = offers.filter("coupon_code IS NOT NULL").select(
        "link", (F.col("collected_at") + F.expr("INTERVAL 1 MICROSECOND")).alias("accepted_at"))
    moved = offers.withColumn("asked_at", F.col("collected_at"))
    return dedup.unseen_within(moved, seen, "link", "asked_at", _TTL_DAYS * 86400).select("oid")


@query("""WITH RECURSIVE e AS (SELECT event_id, ts, user_id || '|' || event_type AS key FROM events),
  firsts AS (SELECT key, min(ts) AS ts FROM e GROUP BY key),
  chain AS (SELECT key, ts FROM firsts UNION ALL
    SELECT c.key, (SELECT min(x.ts) FROM e x WHERE x.key = c.key AND x.ts >= c.ts + INTERVAL 24 HOUR) AS ts
    FROM chain c WHERE c.ts IS NOT NULL)
  SELECT key, count(*) AS accepted, epoch_us(max(ts)) AS last_accepted FROM chain WHERE ts IS NOT NULL GROUP BY key""")
def dedup_ttl(spark, sf):
    """J2, ST2 semantics over the whole history of keys."""
    accepted = dedup.replay_ttl(events(spark, sf), "key", "ts", ["ts", "event_id"])
    return accepted.groupBy("key").agg(
        F.count("*").alias("accepted"), F.unix_micros(F.max("ts")).alias("last_accepted"))


@query(f"""{OFFERS_SQL}, seen AS (SELECT norm_link FROM offers_v WHERE l_shipdate < '{HISTORY_END}'),
  asked AS (SELECT norm_link FROM offers_v WHERE l_shipdate >= '{HISTORY_END}'),
  n AS (SELECT (SELECT count(*) FROM asked) AS a, (SELECT count(*) FROM asked WHERE norm_link NOT IN (SELECT norm_link FROM seen)) AS m,
    (SELECT count(DISTINCT norm_link) FROM seen) AS s)
  SELECT a - m AS hits, m AS misses, s AS size, (a - m) / a::DOUBLE * 100 AS hit_rate FROM n""")
def key_reuse(spark, sf):
    """A7."""
    offers = normalized(spark, sf)
    seen = offers.filter(f"l_shipdate < '{HISTORY_END}'").select(
        "link", F.col("collected_at").alias("accepted_at"))
    asked = offers.filter(f"l_shipdate >= '{HISTORY_END}'")
    return dedup.key_reuse(asked, seen, "link", "collected_at", 20 * 365 * 86400)


# Titles of known similarity: one letter 20 times, then k times x. Two of them have 20 letters in common if the
# first letter is the same, and the smaller number of x in any case.
def coded_title(code, k):
    letter = F.decode(F.unhex(F.hex(F.lit(0x4E00) + code)), "UTF-16BE")
    return F.concat(F.repeat(letter, F.lit(20)), F.repeat(F.lit("x"), k.cast("int")))


def _coded_sql(code, k):
    return f"repeat(chr((19968 + {code})::INTEGER), 20) || repeat('x', {k}::INTEGER)"


def _ratio_sql(c1, k1, c2, k2):
    return f"2.0 * (CASE WHEN {c1} = {c2} THEN 20 ELSE 0 END + least({k1}, {k2})) / (40 + {k1} + {k2})"


_CUSTOMERS = """customers AS (SELECT c_custkey AS id, c_custkey * 7919 % 230 AS c, c_custkey % 10 AS k,
  'https://www.docs.example/' || c_nationkey || '/' || c_custkey % 97 AS link FROM customer)"""


def _coded_customers(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("id"), coded_title(key * 7919 % 230, key % 10).alias("title"),
        F.concat(F.lit("https://www.docs.example/"), "c_nationkey", F.lit("/"), key % 97).alias("link"))


def first_wins_sql(rows: str, recent: str = "[]::STRUCT(c BIGINT, k BIGINT)[]") -> str:
    """G1 as one step per row of ``rows`` (n from 1, c, k, link), with the last 200 titles and the accepted links."""
    like = _ratio_sql("r.c", "r.k", "t.c", "t.k")
    dull = "list_contains(s.links, r.link)"
    same = f"len(list_filter(s.recent, lambda t: {like} >= 0.85)) > 0"
    return f"""steps AS (SELECT 0::BIGINT AS n, {recent} AS recent, []::VARCHAR[] AS links, '' AS verdict
    UNION ALL SELECT r.n, CASE WHEN {dull} OR {same} THEN s.recent ELSE list_append(s.recent, {{'c': r.c, 'k': r.k}})[-200:] END,
      CASE WHEN {dull} OR {same} THEN s.links ELSE list_append(s.links, r.link) END,
      CASE WHEN {dull} THEN 'same_link' WHEN {same} THEN 'similar_title' ELSE 'accepted' END
    FROM steps s JOIN {rows} r ON r.n = s.n + 1)"""


@query(f"""WITH {_CUSTOMERS}, recent AS (SELECT c, k FROM customers WHERE id % 3 = 0 ORDER BY id DESC LIMIT 200)
  SELECT id FROM customers a WHERE id % 3 <> 0 AND NOT EXISTS (
    SELECT 1 FROM recent r WHERE {_ratio_sql('a.c', 'a.k', 'r.c', 'r.k')} >= 0.85)""")
def dedup_fuzzy(spark, sf):
    """Two thirds of the titles, without those like the 200 newest of the others."""
    rows = _coded_customers(spark, sf)
    recent = dedup.recent_titles(rows.filter("id % 3 = 0"), [F.col("id").desc()])
    return dedup.unlike_recent(rows.filter("id % 3 <> 0"), recent).select("id")


_FOURS = """fours AS (SELECT c_custkey AS id, c_custkey // 4 % 20000 AS c, c_custkey * 13 % 30 AS k FROM customer)"""


@query(f"""WITH {_FOURS}, known AS (SELECT DISTINCT c, k FROM fours WHERE id % 3 = 0),
  asked AS (SELECT DISTINCT c, k FROM fours WHERE id % 3 <> 0),
  fresh AS (SELECT c, k FROM asked a WHERE NOT EXISTS (SELECT 1 FROM known r WHERE {_ratio_sql('a.c', 'a.k', 'r.c', 'r.k')} >= 0.85))
  SELECT id FROM fours JOIN fresh USING (c, k) WHERE id % 3 <> 0""")
def titles_unlike_known(spark, sf):
    """J3 with a whole table: two thirds of the titles, without those like any title of the others."""
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        key.alias("id"), coded_title(F.floor(key / 4) % 20000, key * 13 % 30).alias("title"))
    return titles.unlike_known(rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0")).select("id")


@query(f"""WITH {_CUSTOMERS}, s AS (SELECT DISTINCT s_suppkey * 31 % 230 AS c, s_suppkey % 9 AS k FROM supplier),
  a AS (SELECT DISTINCT c, k FROM customers)
  SELECT {_coded_sql('a.c', 'a.k')} AS norm, {_coded_sql('s.c', 's.k')} AS other_norm, CAST({_ratio_sql('a.c', 'a.k', 's.c', 's.k')} AS DOUBLE) AS ratio
  FROM a JOIN s ON (a.c <> s.c OR a.k <> s.k) AND {_ratio_sql('a.c', 'a.k', 's.c', 's.k')} >= 0.85""")
def titles_similar_pairs(spark, sf):
    """J3, UD1: all pairs of different titles of customers and suppliers that resemble each other."""
    key = F.col("s_suppkey")
    known = table(spark, sf, "supplier").select(normalize_title(coded_title(key * 31 % 230, key % 9)).alias("norm"))
    return titles.similar_pairs(_coded_customers(spark, sf).select(normalize_title(F.col("title")).alias("norm")), known)


@query(f"""WITH RECURSIVE {_CUSTOMERS}, numbered AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM customers),
  {first_wins_sql('numbered')} SELECT id, verdict FROM numbered JOIN steps USING (n)""")
def dedup_composite(spark, sf):
    """G1: links and titles, first wins; the recent titles slide."""
    return first_wins(_coded_customers(spark, sf), ["id"], chunk_rows=2000).select("id", "verdict")


@query(f"""WITH RECURSIVE {_CUSTOMERS}, numbered AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM customers),
  {first_wins_sql('numbered')}, v AS (SELECT verdict FROM steps WHERE n > 0)
  SELECT count(*) AS total_checked, count(*) FILTER (verdict = 'accepted') AS "unique", count(*) FILTER (verdict <> 'accepted') AS duplicates,
  count(*) FILTER (verdict = 'same_link') AS same_link, count(*) FILTER (verdict = 'similar_title') AS similar_title,
  printf('%.1f%%', count(*) FILTER (verdict <> 'accepted') / count(*)::DOUBLE * 100) AS duplicate_rate FROM v""")
def duplicate_funnel(spark, sf):
    """A5."""
    return counts.duplicate_funnel(first_wins(_coded_customers(spark, sf), ["id"], chunk_rows=2000))


@query()
def dedup_composite_offers(spark, sf):
    """G1, A5 over all offers: the funnel of the layers."""
    offers = offers_view(spark, sf).select(*ARRIVAL, "link", "title")  # the funnel counts verdicts; others needn't be written down
    return counts.duplicate_funnel(first_wins(offers, ARRIVAL))


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_custkey, o_orderkey * 7919 % 5 AS c, o_orderkey % 10 AS k FROM orders),
  b AS (SELECT *, lag(c) OVER w AS pc, lag(k) OVER w AS pk FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY id))
  SELECT id, CAST({_ratio_sql('c', 'k', 'pc', 'pk')} AS DOUBLE) AS ratio FROM b WHERE pc IS NOT NULL""")
def title_similarity(spark, sf):
    """UD1: the title of every order against that of its customer's order before."""
    from pyspark.sql import Window
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        key.alias("id"), "o_custkey", normalize_title(coded_title(key * 7919 % 5, key % 10)).alias("norm"))
    before = F.lag("norm").over(Window.partitionBy("o_custkey").orderBy("id"))
    return rows.withColumn("before", before).filter(F.col("before").isNotNull()).select(
        "id", title_ratio(F.col("norm"), F.col("before")).alias("ratio"))


# --- coupons -------------------------------------------------------------------------
def _coupon_table(spark, sf):
    parts = table(spark, sf, "part")
    by_size = parts.groupBy("p_size").agg(F.min("p_partkey").alias("k"))
    shops = F.explode(F.array(*[F.lit(s) for s in STORES]))
    return by_size.select(
        shops.alias("store"), F.concat(F.lit("CUP"), F.col("p_size")).alias("code"),
        ((F.col("p_size") - 1) * 40).cast("decimal(12,2)").alias("min_value"),
        (F.col("k") * 7 % 50).cast("decimal(12,2)").alias("discount_value"), F.col("p_size").cast("int").alias("seq"))


@query(f"""{OFFERS_SQL}, cup AS (SELECT 'CUP' || p_size AS code, (p_size - 1) * 40 AS mv, min(p_partkey) * 7 % 50 AS dv, p_size AS seq
    FROM part GROUP BY p_size)
  SELECT o.oid, coalesce(any_value(o.coupon_code), arg_max(c.code, dv * 100000 - seq)) AS coupon_code
  FROM offers_v o LEFT JOIN cup c ON c.mv > 0 AND o.price >= c.mv GROUP BY o.oid""")
def coupon_best_match(spark, sf):
    """J5, L5."""
    return lookup.apply_best_coupon(offers_view(spark, sf), _coupon_table(spark, sf)).select("oid", "coupon_code")


@query("""WITH t AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_brand || ' ' || p_type) AS title FROM part),
  r AS (SELECT lower(p_name || ' ' || p_brand) AS keyword, (p_partkey % 9)::INTEGER AS weight, p_partkey AS priority FROM part)
  SELECT id, arg_min(weight, priority) AS weight FROM t LEFT JOIN r ON contains(title, keyword) GROUP BY id""")
def keyword_rules(spark, sf):
    """As many rules as parts, kept as a table."""
    parts = table(spark, sf, "part")
    named = parts.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"))
    rules = parts.select(F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("keyword"),
                         (F.col("p_partkey") % 9).cast("int").alias("weight"), F.col("p_partkey").alias("priority"))
    return lookup.first_rule(named, rules).select("id", "weight")


# --- sources and run log ----------------------------------------------------------------
NOW = "2024-01-20 00:00:00"
SOURCE_NAMES = ("view", "click", "signup", "checkout", "purchase")


def _names(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "source string")


def run_log(spark, sf):
    """Events read as source runs."""
    e = events(spark, sf)
    return history.run_rows(e.select(
        F.col("event_type").alias("source"), F.col("ts").alias("run_at"), F.col("value").alias("duration_secs"),
        (F.col("user_id") % 40).alias("items_found"), (F.col("user_id") % 7).alias("items_sent"),
        F.when(F.col("user_id") % 29 == 0, "timeout").when(F.col("user_id") % 31 == 0, "refused").alias("failure"),
        F.when(F.col("event_type") == "error", 2).when(F.col("user_id") % 3 == 0, 1).otherwise(0).alias("errors")))


RUNS_SQL = """WITH runs AS (SELECT event_type AS source, ts AS run_at, user_id % 29 = 0 OR user_id % 31 = 0 AS failed,
  CASE WHEN user_id % 29 = 0 OR user_id % 31 = 0 THEN 0.0 ELSE value END AS duration_secs,
  CASE WHEN user_id % 29 = 0 OR user_id % 31 = 0 THEN 0 ELSE user_id % 40 END AS items_found, user_id % 7 AS items_sent,
  CASE WHEN user_id % 29 = 0 OR user_id % 31 = 0 THEN 1 WHEN event_type = 'error' THEN 2 WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS errors,
  CASE WHEN user_id % 29 = 0 THEN 'timeout' WHEN user_id % 31 = 0 THEN 'exception'
    WHEN event_type = 'error' OR user_id % 3 = 0 THEN 'error' ELSE 'ok' END AS status FROM events)"""


@query(f"{RUNS_SQL} SELECT status, count(*) AS runs, CAST(sum(items_found) AS BIGINT) AS found, CAST(sum(errors) AS BIGINT) AS errors, round(sum(duration_secs), 2) AS secs FROM runs GROUP BY status")
def run_log_status(spark, sf):
    """SK3, A11."""
    return run_log(spark, sf).groupBy("status").agg(
        F.count("*").alias("runs"), F.sum("items_found").alias("found"), F.sum("errors").alias("errors"),
        F.round(F.sum("duration_secs"), 2).alias("secs"))


_STATS = f"""stats AS (SELECT source, count(*) AS runs, CAST(sum(items_found) AS BIGINT) AS total_found, CAST(sum(items_sent) AS BIGINT) AS total_sent,
  CAST(sum(errors) AS BIGINT) AS total_errors, round(avg(duration_secs), 9) AS avg_duration FROM runs
  WHERE run_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR GROUP BY source)"""


@query(f"{RUNS_SQL}, {_STATS} SELECT * FROM stats")
def source_stats_24h(spark, sf):
    """A1, F10, SC19."""
    return history.source_stats(run_log(spark, sf), F.lit(NOW).cast("timestamp")).withColumn(
        "avg_duration", F.round("avg_duration", 9))


@query(f"""{RUNS_SQL}, {_STATS}, enabled AS (SELECT unnest({list(SOURCE_NAMES)}) AS source)
  SELECT source, coalesce(runs, 0) AS runs, coalesce(total_found, 0) AS total_found, coalesce(total_errors, 0) AS total_errors,
  CASE WHEN runs IS NULL THEN 'no data' WHEN total_errors = 0 THEN 'ok' WHEN total_errors < runs THEN 'warn' ELSE 'fail' END AS health
  FROM enabled LEFT JOIN stats USING (source)""")
def source_health(spark, sf):
    """J9, P34."""
    report = reports.source_health(_names(spark, *SOURCE_NAMES), run_log(spark, sf), F.lit(NOW).cast("timestamp"))
    return report.select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "total_found", "total_errors")], "health")


@query(f"SELECT DISTINCT event_type AS source FROM events WHERE event_type NOT IN ('view', 'click')")
def source_disabled(spark, sf):
    """J10, O3, L6."""
    available = events(spark, sf).select(F.col("event_type").alias("source")).distinct()
    return reports.disabled_sources(available, _names(spark, "view", "click"))


@query("SELECT DISTINCT event_type AS source, event_type IN ('view', 'click') AS active FROM events")
def source_states(spark, sf):
    """J11, L6."""
    available = events(spark, sf).select(F.col("event_type").alias("source")).distinct()
    return reports.source_states(available, _names(spark, "view", "click"))


@query("SELECT event_type AS store, count(*) AS rows FROM events WHERE event_type IN ('view', 'signup') GROUP BY 1")
def source_semi(spark, sf):
    """J8, SC21."""
    rows = events(spark, sf).withColumnRenamed("event_type", "store")
    return lookup.of_enabled_sources(rows, _names(spark, " View", "SIGNUP ", "other")).groupBy("store").agg(
        F.count("*").alias("rows"))


@query(f"""{RUNS_SQL} SELECT source, count(*) AS runs, CAST(sum(items_found) AS BIGINT) AS total_items, CAST(sum(errors) AS BIGINT) AS total_errors,
  count(*) FILTER (status = 'ok') AS ok_runs, count(*) FILTER (status = 'error') AS error_runs,
  count(*) FILTER (status = 'exception') AS exception_runs, count(*) FILTER (status = 'timeout') AS timeout_runs FROM runs GROUP BY source""")
def source_totals(spark, sf):
    """A9, A11."""
    return counts.per_source(run_log(spark, sf))


# --- history -----------------------------------------------------------------------------
def observations(spark, sf):
    return normalized(spark, sf).withColumnRenamed("collected_at", "recorded_at")


_SERIES_ORDER = ["recorded_at", *ARRIVAL[1:]]


@query(f"""{OFFERS_SQL} SELECT oid, CAST(price AS DOUBLE) AS price, CAST(min(price) OVER w AS DOUBLE) AS lowest_so_far,
  CAST(lag(price) OVER (PARTITION BY norm_link ORDER BY {ARRIVAL_SQL}) AS DOUBLE) AS previous_price,
  CAST(price - lag(price) OVER (PARTITION BY norm_link ORDER BY {ARRIVAL_SQL}) AS DOUBLE) AS change, price = min(price) OVER w AS at_lowest
  FROM offers_v WINDOW w AS (PARTITION BY norm_link ORDER BY {ARRIVAL_SQL} ROWS UNBOUNDED PRECEDING)""")
def price_series(spark, sf):
    """W7, L8."""
    return plain(history.price_series(observations(spark, sf), _SERIES_ORDER).select(
        "oid", "price", "lowest_so_far", "previous_price", "change", "at_lowest"))


@query(f"{OFFERS_SQL} SELECT norm_link AS link, CAST(min(price) AS DOUBLE) AS lowest_price FROM offers_v GROUP BY 1")
def lowest_price(spark, sf):
    """A3."""
    return plain(history.lowest_price(observations(spark, sf)))


@query(f"""{OFFERS_SQL} SELECT norm_link AS link, CAST(price AS DOUBLE) AS price, epoch_us(collected_at) AS at FROM offers_v
  WHERE norm_link IN (SELECT norm_link FROM offers_v WHERE price > 2000)""")
def prices_of_links(spark, sf):
    """All prices of links that once cost more than 2000."""
    seen = observations(spark, sf)
    return plain(history.prices_of(seen, seen.filter("price > 2000")).select(
        "link", "price", F.unix_micros("recorded_at").alias("at")))


@query(f"""{OFFERS_SQL} SELECT norm_link AS link, store, substr(title, 1, 50) AS title,
  CASE WHEN price <> 0 THEN 'R$' || printf('%.2f', CAST(price AS DOUBLE)) ELSE 'N/A' END AS price
  FROM offers_v ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10""")
def recent_offers(spark, sf):
    """L3, P38."""
    order = [F.col("l_shipdate").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return reports.recent_offers(normalized(spark, sf), order)


CUTOFF = "2000-06-30"


@query(f"{OFFERS_SQL} SELECT oid FROM offers_v WHERE collected_at >= TIMESTAMP '{CUTOFF}' - INTERVAL 30 DAY")
def retention(spark, sf):
    """SK6."""
    sent = normalized(spark, sf).withColumnRenamed("collected_at", "sent_at")
    return history.kept_since(sent, F.lit(CUTOFF).cast("timestamp")).select("oid")


_ABSENT = f"""absent AS (SELECT * FROM offers_v WHERE l_shipdate >= '{HISTORY_END}'
  AND norm_link NOT IN (SELECT norm_link FROM offers_v WHERE l_shipdate < '{HISTORY_END}')
  QUALIFY row_number() OVER (PARTITION BY norm_link ORDER BY {ARRIVAL_SQL}) = 1)"""


def _inserted(spark, sf):
    offers = normalized(spark, sf).withColumn("score", F.lit(0.0))
    rows = history.as_sent(offers, F.col("collected_at"), F.lit(1)).columns
    sent = offers.filter(f"l_shipdate < '{HISTORY_END}'")
    new = offers.filter(f"l_shipdate >= '{HISTORY_END}'")
    kept = history.insert_if_absent(new, sent, ARRIVAL)
    return history.as_sent(kept, F.col("collected_at"), F.lit(1)).select(*rows)


@query(f"""{OFFERS_SQL}, {_ABSENT} SELECT norm_link AS link, title, store, category, CAST(price AS DOUBLE) AS price,
  CAST(original_price AS DOUBLE) AS original_price, tenths / 10.0::DOUBLE AS discount_pct, epoch_us(collected_at) AS sent_at FROM absent""")
def insert_if_absent(spark, sf):
    """SK1, SK4."""
    return plain(_inserted(spark, sf).select(
        "link", "title", "store", "category", "price", "original_price", "discount_pct",
        F.unix_micros("sent_at").alias("sent_at")))


@query(f"{OFFERS_SQL}, {_ABSENT} SELECT norm_link AS link, CAST(price AS DOUBLE) AS price, epoch_us(collected_at) AS at FROM absent WHERE price IS NOT NULL")
def price_points(spark, sf):
    """SK2."""
    return plain(history.price_points(_inserted(spark, sf)).select(
        "link", "price", F.unix_micros("recorded_at").alias("at")))


@query(f"{OFFERS_SQL}, {_ABSENT} SELECT count(*) AS promos FROM absent")
def sent_count(spark, sf):
    """A2."""
    return history.sent_count(_inserted(spark, sf))


# --- unions, caps, counts -------------------------------------------------------------------
def _staged(spark, sf):
    return normalized(spark, sf).withColumn("tier", (F.col("l_linenumber") - 1).cast("int")).withColumn(
        "batch_id", F.year("l_shipdate") * 12 + F.month("l_shipdate"))


@query(f"""{OFFERS_SQL}, s AS (SELECT *, l_linenumber - 1 AS tier, year(l_shipdate) * 12 + month(l_shipdate) AS b FROM offers_v),
  firsts AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY b, store, norm_link ORDER BY tier, {ARRIVAL_SQL}) = 1)
  SELECT oid, tier FROM firsts f WHERE (SELECT count(*) FROM firsts g WHERE g.b = f.b AND g.store = f.store AND g.tier < f.tier)
    < CASE WHEN tier <= 1 THEN 30 ELSE 10 END""")
def tiered_union(spark, sf):
    """Tiers of a batch and source fill up only what the earlier ones left short."""
    firsts = tiers.keep_first(_staged(spark, sf), ["batch_id", "store", "link"], ["tier", *ARRIVAL])
    limit = F.when(F.col("tier") <= 1, 30).otherwise(10)
    return tiers.until_enough(firsts, ["batch_id", "store"], ["tier"], limit, most=30).select("oid", "tier")


@query(f"{OFFERS_SQL} SELECT oid FROM offers_v QUALIFY row_number() OVER (PARTITION BY store, year(l_shipdate), month(l_shipdate) ORDER BY {ARRIVAL_SQL}) <= 30")
def cap_per_source(spark, sf):
    """W5."""
    return tiers.cap_per_group(_staged(spark, sf), ["store", "batch_id"], ARRIVAL, 30).select("oid")


@query(f"""{OFFERS_SQL} SELECT store, substr(title, 1, 60) AS title,
  concat_ws(' | ', 'R$' || printf('%.2f', CAST(price AS DOUBLE)), coupon_code, CASE WHEN image_url <> '' THEN 'image' END) AS details
  FROM offers_v QUALIFY row_number() OVER (PARTITION BY store ORDER BY {ARRIVAL_SQL}) <= 5""")
def source_samples(spark, sf):
    """L7, P38."""
    return reports.source_samples(offers_view(spark, sf), ARRIVAL)


@query("""SELECT DISTINCT lower(p_type) AS keyword FROM part UNION SELECT DISTINCT lower(p_brand) FROM part
  EXCEPT SELECT DISTINCT lower(p_type) FROM part WHERE p_type LIKE 'S%'""")
def rule_union(spark, sf):
    """O5."""
    part = table(spark, sf, "part")
    words = lambda c: part.select(F.col(c).alias("keyword"))
    return reports.blocked_words(words("p_type"), words("p_brand"), words("p_type").filter("keyword LIKE 'S%'"))


_FAILED = "length(html) % 3 = 0"


@query(f"""SELECT split_part(split_part(url, '://', 2), '/', 1) AS domain, count(*) AS errors FROM pages WHERE {_FAILED}
  GROUP BY 1 ORDER BY errors DESC, domain LIMIT 5""")
def error_domains_top5(spark, sf):
    """A8, L4."""
    return counts.error_domains(table(spark, sf, "pages"), F.expr(_FAILED))


@query(f"""SELECT count(*) AS total_requests, count(*) FILTER ({_FAILED}) AS total_errors,
  printf('%.1f%%', count(*) FILTER ({_FAILED}) / greatest(count(*), 1)::DOUBLE * 100) AS error_rate FROM pages""")
def error_rate(spark, sf):
    """A8, P35."""
    return counts.error_rate(table(spark, sf, "pages"), F.expr(_FAILED))


_CYCLES = f"""{SCORED_SQL}, flagged AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS batch_id, {_REASON} IS NULL AS f,
  row_number() OVER (PARTITION BY norm_link ORDER BY {ARRIVAL_SQL}) = 1 AS u, score >= 60 AS s FROM scored),
  cycles AS (SELECT batch_id, count(*) AS collected, count(*) FILTER (f) AS filtered, count(*) FILTER (f AND u) AS "unique",
  count(*) FILTER (f AND u AND s) AS sent FROM flagged GROUP BY batch_id)"""


def _cycles(spark, sf):
    from pyspark.sql import Window
    offers = quality.quality_gate(scored_offers(spark, sf), blocked=BLOCKED_WORDS)
    firsts = tiers.keep_first(
        offers.withColumn("link", normalize_link(F.col("link"))), ["link"], ARRIVAL).select(
        "oid", F.lit(True).alias("first"))
    flagged = offers.join(firsts, "oid", "left").withColumn(
        "batch_id", F.year("l_shipdate") * 12 + F.month("l_shipdate"))
    return counts.cycle_funnel(
        flagged, "batch_id", F.col("reason").isNull(), F.coalesce("first", F.lit(False)), F.col("score") >= 60)


@query(f"{_CYCLES} SELECT * FROM cycles")
def funnel_metrics(spark, sf):
    """A6."""
    return _cycles(spark, sf)


@query(f"""{_CYCLES} SELECT batch_id, collected, sent, CAST(sum(collected) OVER w AS BIGINT) AS total_collected,
  CAST(sum(sent) OVER w AS BIGINT) AS total_sent FROM cycles WINDOW w AS (ORDER BY batch_id ROWS UNBOUNDED PRECEDING)""")
def running_totals(spark, sf):
    """W6."""
    return counts.running_totals(_cycles(spark, sf), "batch_id", ["collected", "sent"], block=16)


@query(f"{OFFERS_SQL} SELECT store, count(DISTINCT norm_link) AS distinct_keys FROM offers_v GROUP BY store")
def distinct_keys(spark, sf):
    """A12."""
    return counts.distinct_keys(normalized(spark, sf), "link", ["store"])


# --- the cycle ----------------------------------------------------------------------------------
OPTIONS = CycleOptions(
    gate={"blocked": BLOCKED_WORDS}, scoring={"value_keywords": VALUE_WORDS, "low_value": LOW_WORDS})


_CODE, _EXTRA = "(l_partkey * 7 + l_suppkey) % 2000", "l_linenumber * 3 % 10"
_CODED_OFFERS = OFFERS_SQL.replace(
    "p_name || ' ' || p_brand || ' ' || p_type || ' size ' || p_size AS title", f"{_coded_sql(_CODE, _EXTRA)} AS title")
assert _CODED_OFFERS != OFFERS_SQL


def coded_offers(spark, sf):
    """The offers with titles of known similarity."""
    return offers_view(spark, sf).withColumn("title", coded_title(F.expr(_CODE), F.expr(_EXTRA)))


@query(f"""{SCORED_SQL.replace(OFFERS_SQL, _CODED_OFFERS).replace('WITH ', 'WITH RECURSIVE ', 1)},
  fresh AS (SELECT *, {_CODE} AS c, {_EXTRA} AS k, norm_link AS nl,
    row_number() OVER (ORDER BY {ARRIVAL_SQL}) AS n FROM scored WHERE {_REASON} IS NULL AND l_shipdate >= '{HISTORY_END}'
    AND norm_link NOT IN (SELECT norm_link FROM offers_v WHERE l_shipdate < '{HISTORY_END}')),
  rows_ AS (SELECT n, c, k, nl AS link FROM fresh), {first_wins_sql('rows_')}
  SELECT oid, store, title, norm_link AS link, CAST(price AS DOUBLE) AS price, score FROM fresh JOIN steps USING (n)
  WHERE verdict = 'accepted' AND score >= 15 ORDER BY score DESC, {ARRIVAL_SQL} LIMIT 10""")
def cycle_top10(spark, sf):
    """The best offers of all later offers, given the earlier ones as published."""
    offers = coded_offers(spark, sf)
    sent = normalized(spark, sf).filter(f"l_shipdate < '{HISTORY_END}'")
    result = run_cycle(offers.filter(f"l_shipdate >= '{HISTORY_END}'"), ARRIVAL, sent=sent, options=OPTIONS)
    return result.published.select("oid", "store", "title", "link", F.col("price").cast("double").alias("price"), "score")


@query(f"""{SCORED_SQL}, fresh AS (SELECT * FROM scored WHERE {_REASON} IS NULL AND l_shipdate >= '{HISTORY_END}'
    AND norm_link NOT IN (SELECT norm_link FROM offers_v WHERE l_shipdate < '{HISTORY_END}')
    QUALIFY row_number() OVER (PARTITION BY norm_link ORDER BY {ARRIVAL_SQL}) = 1)
  SELECT oid, store, score FROM fresh WHERE score >= 15 ORDER BY score DESC, {ARRIVAL_SQL} LIMIT 10""")
def cycle_top10_links_only(spark, sf):
    """The cycle without the title comparison, all of it one plan."""
    from vitrine.operators import scoring
    gated = quality.quality_gate(normalized(spark, sf), blocked=BLOCKED_WORDS).filter("reason IS NULL")
    sent = normalized(spark, sf).filter(f"l_shipdate < '{HISTORY_END}'")
    fresh = dedup.unpublished(gated.filter(f"l_shipdate >= '{HISTORY_END}'"), sent)
    unique = tiers.keep_first(fresh, ["link"], ARRIVAL)
    scored = scoring.score(unique, value_keywords=VALUE_WORDS, low_value=LOW_WORDS)
    return scoring.best_offers(scored, ARRIVAL).select("oid", "store", "score")
