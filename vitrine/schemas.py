"""Canonical table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
PERCENT = T.DecimalType(6, 1)

RAW_PAYLOADS = T.StructType([
    T.StructField("store", T.StringType()),
    T.StructField("page_url", T.StringType()),
    T.StructField("page_rank", T.IntegerType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("kind", T.StringType()),
    T.StructField("body", T.StringType()),
])

OFFERS = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("collected_at", T.TimestampType()),
    T.StructField("store", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("price", MONEY),
    T.StructField("original_price", MONEY),
    T.StructField("discount_pct", PERCENT),
    T.StructField("category", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("coupon_code", T.StringType()),
    T.StructField("free_shipping", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])

SENT_OFFERS = T.StructType([
    T.StructField("link", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("price", MONEY),
    T.StructField("original_price", MONEY),
    T.StructField("discount_pct", PERCENT),
    T.StructField("store", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("sent_at", T.TimestampType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("sent_date", T.DateType()),
])

PRICE_HISTORY = T.StructType([
    T.StructField("link", T.StringType()),
    T.StructField("price", MONEY),
    T.StructField("recorded_at", T.TimestampType()),
    T.StructField("batch_id", T.LongType()),
])

SOURCE_RUNS = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("run_at", T.TimestampType()),
    T.StructField("duration_secs", T.DoubleType()),
    T.StructField("items_found", T.LongType()),
    T.StructField("items_sent", T.LongType()),
    T.StructField("errors", T.LongType()),
    T.StructField("status", T.StringType()),
])

COUPONS = T.StructType([
    T.StructField("store", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("min_value", MONEY),
    T.StructField("discount_value", MONEY),
    T.StructField("seq", T.IntegerType()),
])
