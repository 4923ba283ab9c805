"""The offers view both engines derive from ``lineitem`` and ``part``, and payloads built from it.

Prices are integer cents first, so both engines agree to the last digit. ``ARRIVAL`` orders the offers
totally; ``oid`` names one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

STORES = ("amazon", "kabum", "aliexpress", "shopee", "pelando", "promobit", "terabyte", "mercadolivre")
ARRIVAL = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
ORIGINS = ("Amazon", "Magazine Luiza BR", "C&A", "Loja XYZ", "Netshoes", "", "")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Share a sample table, which is one file of one row group, among the cores of a local session."""
    context = rows.sparkSession.sparkContext
    return rows.repartition(context.defaultParallelism) if context.master.startswith("local[") else rows


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The same table as a file stream."""
    return spark.readStream.schema(table(spark, sf, name).schema).option(
        "pathGlobFilter", f"{name}.parquet").parquet(sf)


def offers_view(spark: SparkSession, sf: str, lines: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """``by``: deal the offers out by this column, as long as they are few narrow columns."""
    lines = table(spark, sf, "lineitem") if lines is None else lines
    parts = table(spark, sf, "part")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    percent = F.round(F.col("l_discount") * 100).cast("bigint")
    lines = lines.select(
        *ARRIVAL, "l_returnflag", "l_linestatus", cents.alias("ep"), percent.alias("dp"))
    if not lines.isStreaming and by is None:
        lines = spread(lines)
    money = lambda c: F.expr(
        f"CAST(CAST({c} AS DECIMAL(14,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2))")
    shop = F.col("l_suppkey") % 8
    joined = lines.join(parts.drop("p_retailprice"), lines["l_partkey"] == parts["p_partkey"])
    return (
        (joined if by is None else joined.drop("p_partkey").repartition(by))
        .withColumn("original_cents", F.expr("ep div 50"))
        .withColumn("price_cents", F.expr("ep * (100 - 8 * dp) div 5000"))
        # a generator keeps the derived columns columns: Spark would copy their expressions into every
        # filter it pushes down, and compute them again there
        .select(*ARRIVAL, "original_cents", "price_cents", F.inline(F.array(F.struct(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("oid"),
            F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" "), F.col("p_type"),
                     F.lit(" size "), F.col("p_size")).alias("title"),
            F.concat(F.lit("https://www.shop"), shop, F.lit(".example/p/"), F.col("l_partkey"),
                     F.lit("?utm_source=feed&ref="), F.col("l_linenumber")).alias("link"),
            F.element_at(F.array(*[F.lit(s) for s in STORES]), (shop + 1).cast("int")).alias("store"),
            money("price_cents").alias("price"), money("original_cents").alias("original_price"),
            F.expr("""CASE WHEN original_cents > price_cents AND price_cents > 0 THEN
                CAST((2000 * (original_cents - price_cents) + original_cents) div (2 * original_cents)
                AS DECIMAL(8,0)) * CAST(0.1 AS DECIMAL(2,1)) END""").cast("decimal(6,1)").alias("discount_pct"),
            F.when(F.col("l_returnflag") == "R", F.concat(F.lit("SAVE"), F.col("l_linenumber"))).alias("coupon_code"),
            (F.col("l_linestatus") == "F").alias("free_shipping"),
            F.col("l_shipdate").cast("timestamp").alias("collected_at"),
            F.concat(F.col("p_type"), F.lit("/"), F.col("p_brand")).alias("menu"),
            F.col("p_type").alias("category"),
            F.when(F.col("l_linenumber") % 3 == 0, F.concat(
                F.lit("https://img.example/photo/"), F.col("l_partkey"), F.lit(".jpg")))
            .when(F.col("l_linenumber") % 3 == 1, "").otherwise("https://img.example/placeholder.png").alias("image_url"),
            F.element_at(F.array(*[F.lit(o) for o in ORIGINS]), F.col("l_linenumber").cast("int")).alias("origin"),
        ))))
        .withColumn("extra", F.create_map(F.lit("origin_store"), F.col("origin")))
    )


def _sql_list(values) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


OFFERS_SQL = f"""
WITH cents AS (
  SELECT l.*, p.*, CAST(round(l_extendedprice * 100) AS BIGINT) // 50 AS original_cents,
    CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - 8 * CAST(round(l_discount * 100) AS BIGINT)) // 5000 AS price_cents
  FROM lineitem l JOIN part p ON l_partkey = p_partkey),
offers_v AS (
  SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, original_cents, price_cents,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS oid,
    p_name || ' ' || p_brand || ' ' || p_type || ' size ' || p_size AS title,
    'https://www.shop' || (l_suppkey % 8) || '.example/p/' || l_partkey || '?utm_source=feed&ref=' || l_linenumber AS link,
    'https://shop' || (l_suppkey % 8) || '.example/p/' || l_partkey AS norm_link,
    ({_sql_list(STORES)})[(l_suppkey % 8) + 1] AS store,
    CAST(CAST(price_cents AS DECIMAL(14,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS price,
    CAST(CAST(original_cents AS DECIMAL(14,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS original_price,
    CASE WHEN original_cents > price_cents AND price_cents > 0
      THEN (2000 * (original_cents - price_cents) + original_cents) // (2 * original_cents) END AS tenths,
    CASE WHEN l_returnflag = 'R' THEN 'SAVE' || l_linenumber END AS coupon_code,
    l_linestatus = 'F' AS free_shipping, l_shipdate AS collected_at,
    p_type || '/' || p_brand AS menu, p_type AS category, p_size, p_retailprice,
    CASE WHEN l_linenumber % 3 = 0 THEN 'https://img.example/photo/' || l_partkey || '.jpg'
      WHEN l_linenumber % 3 = 1 THEN '' ELSE 'https://img.example/placeholder.png' END AS image_url,
    ({_sql_list(ORIGINS)})[l_linenumber] AS origin
  FROM cents)
"""
ARRIVAL_SQL = ", ".join(ARRIVAL)


# --- payloads ------------------------------------------------------------------
def one_page_per_order(offers: DataFrame, piece: Column, kind: str, before: str = "", between: str = "",
                       after: str = "") -> DataFrame:
    """Captured pages: the pieces of one order's offers, in arrival order, as one body.

    An order holds few lines, so a page stays small.
    """
    pieces = F.sort_array(F.collect_list(F.struct(*ARRIVAL, piece.alias("piece"))))
    return offers.groupBy("l_orderkey", "store").agg(pieces.alias("pieces")).select(
        F.col("l_orderkey").alias("batch_id"), "store",
        F.concat(F.lit("https://feed.example/"), F.col("l_orderkey")).alias("page_url"),
        F.lit(0).alias("page_rank"), F.lit(None).cast("timestamp").alias("fetched_at"),
        F.lit(kind).alias("kind"),
        F.concat(F.lit(before), F.array_join(F.col("pieces.piece"), between),
                 F.lit(after)).alias("body"),
    )
