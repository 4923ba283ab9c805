"""The offer record every extractor fills, and the step from page to offer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions.pricing import money
from vitrine.schemas import PERCENT

PAGE_COLUMNS = ("batch_id", "store", "page_url", "page_rank", "fetched_at")


def truthy(raw: Column) -> Column:
    """JSON text that counts as true: present, not false, not zero, not empty."""
    return F.coalesce(~raw.isin("", "false", "0", "0.0", "null", "[]", "{}"), F.lit(False))


def first_filled(*candidates: Column) -> Column:
    """P20. First candidate that counts as true."""
    return F.coalesce(*[F.when(truthy(c), c) for c in candidates])


def text_map(**pairs: Column) -> Column:
    """Free-form attributes; missing ones become empty text."""
    flat = []
    for name, value in pairs.items():
        flat += [F.lit(name), F.coalesce(value.cast("string"), F.lit(""))]
    return F.create_map(*flat)


def offer(
    key: Column, title: Column, link: Column, *, ok: Column | None = None,
    price: Column | None = None, original_price: Column | None = None,
    discount_pct: Column | None = None, category: Column | None = None,
    image_url: Column | None = None, coupon_code: Column | None = None,
    free_shipping: Column | None = None, extra: Column | None = None,
) -> Column:
    """One offer as a struct.

    ``key`` is the identity under which the source drops repeats. ``ok`` says whether the record is
    usable; an unusable one may still have used up its key.
    """
    nothing = F.lit(None)
    given = lambda value, default: default if value is None else value
    usable = given(ok, F.lit(True)) & title.isNotNull() & link.isNotNull()
    return F.struct(
        key.cast("string").alias("key"),
        F.coalesce(usable, F.lit(False)).alias("ok"),
        title.alias("title"),
        link.alias("link"),
        money(given(price, nothing)).alias("price"),
        money(given(original_price, nothing)).alias("original_price"),
        given(discount_pct, nothing).try_cast(PERCENT).alias("discount_pct"),
        F.coalesce(given(category, nothing).cast("string"), F.lit("")).alias("category"),
        F.coalesce(given(image_url, nothing).cast("string"), F.lit("")).alias("image_url"),
        given(coupon_code, nothing).cast("string").alias("coupon_code"),
        F.coalesce(given(free_shipping, nothing).cast("boolean"), F.lit(False)).alias("free_shipping"),
        F.coalesce(given(extra, nothing), F.create_map().cast("map<string,string>")).alias("extra"),
    )


def at_most(items: Column, most: int | None) -> Column:
    """W5. The first ``most`` items; all of them for ``None``."""
    return items if most is None else F.slice(items, 1, most)


def computed(rows: DataFrame, fields: Column) -> DataFrame:
    """The fields of a struct as columns, worked out once: a generator keeps Spark from copying their expressions into
    everything that uses them."""
    return rows.withColumn("_fields", fields).select(*rows.columns, F.inline(F.array("_fields")))


def item_rows(pages: DataFrame, items: Column) -> DataFrame:
    """One row per item of a page, as ``item`` with its ``pos``; the items are worked out once."""
    listed = computed(pages.select(*PAGE_COLUMNS, items.alias("items")), F.struct(F.col("items").alias("_items")))
    return listed.select(*PAGE_COLUMNS, F.posexplode("_items").alias("pos", "item"))


def offer_rows(items: DataFrame, found: Column, tier: int | Column) -> DataFrame:
    """Items (page columns, ``pos`` and what ``found`` needs) as offers. Plain columns, so Spark compiles them."""
    return computed(items.select(*PAGE_COLUMNS, (F.lit(tier) if isinstance(tier, int) else tier).alias("tier"), "pos", found.alias("_found")), F.col("_found")).drop("_found")
