"""Column functions over links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from vitrine import fixed_values as fv
from vitrine.functions.text import first_group, non_empty


def url_host(url: Column) -> Column:
    """P26. Host with port, empty when there is none."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


# scheme and fragment go, host stays, the path loses trailing slashes and ;params, a non-empty query stays
_PARTS = (r"(?s)^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*?)/*(?:;[^/?#]*)?(\?[^#]+)?\??(?:#.*)?$")


def normalize_link(link: Column, repair_query: bool = False) -> Column:
    """P13. Comparison form of a link.

    https, no ``www.``, no trailing slash, no fragment, no tracking parameters. Dropping the first
    parameter also drops its ``?``; ``repair_query`` puts it back. Every step uses the one before it
    once, so the expression stays small wherever Spark copies it.
    """
    target = F.regexp_replace(link, _PARTS, "$1$2$3")
    # each match starts where the last one ended and stays within the host
    bare = F.regexp_replace(target, r"\G([^/?]*?)www\.", "$1")
    kept = F.rtrim(F.regexp_replace(bare, fv.LINK_TRACKING, ""), F.lit("?&"))
    if repair_query:
        kept = F.regexp_replace(kept, "^([^?&]*)&", "$1?")
    return F.concat(F.lit("https://"), kept)


def link_key(link: Column) -> Column:
    """P25. Digest under which a link is remembered."""
    return F.concat(F.lit("promo:"), F.md5(link))


def strip_params(url: Column, names: Sequence[str], prefixes: Sequence[str],
                 keep_if_no_query: bool = True) -> Column:
    """P14. Drop query parameters by exact name or prefix (case-insensitive) and the fragment.

    Parameters of one name are kept together at the place of the first, as form decoding does.
    Values are kept as they stand, not re-encoded.
    """
    pairs = F.filter(F.split(_query(url), "&"), lambda p: p != "")
    name = lambda pair: F.substring_index(pair, "=", 1)

    def tracked(pair: Column) -> Column:
        lowered = F.lower(name(pair))
        hit = lowered.isin(*names)
        for prefix in prefixes:
            hit = hit | lowered.startswith(prefix)
        return hit

    kept = F.transform(
        F.filter(pairs, lambda p: ~tracked(p)),
        lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))),
    )
    by_name = F.flatten(F.transform(
        F.array_distinct(F.transform(kept, name)),
        lambda n: F.filter(kept, lambda p: name(p) == n),
    ))
    base = F.regexp_extract(url, r"^[^?#]*", 0)
    query = F.array_join(by_name, "&")
    cleaned = F.when(query != "", F.concat(base, F.lit("?"), query)).otherwise(base)
    if keep_if_no_query:
        return F.when(_query(url) == "", url).otherwise(cleaned)
    return cleaned


def strip_deal_tracking(url: Column) -> Column:
    return strip_params(url, fv.DEAL_TRACKING_NAMES, fv.DEAL_TRACKING_PREFIXES)


def strip_offer_tracking(url: Column) -> Column:
    return strip_params(url, fv.OFFER_TRACKING_NAMES, fv.OFFER_TRACKING_PREFIXES,
                        keep_if_no_query=False)


def drop_query(link: Column, drop_slash: bool = True) -> Column:
    """P15. Everything before the first question mark."""
    bare = F.substring_index(link, "?", 1)
    return F.regexp_replace(bare, "/+$", "") if drop_slash else bare


def product_page(link: Column) -> Column:
    """P16. Canonical ``/dp/`` page of a ten-character product code, else no query."""
    code = first_group(link, "/dp/([A-Z0-9]{10})")
    return F.coalesce(
        F.concat(F.lit("https://www.amazon.com.br/dp/"), code), drop_query(link, drop_slash=False))


# Product identity inside a link, per shop
def product_code(link: Column) -> Column:
    return first_group(link, "/(?:dp|gp/product)/([A-Z0-9]{10})")


def listing_code(link: Column) -> Column:
    number = first_group(link, "MLB-?([0-9]+)")
    return F.coalesce(F.concat(F.lit("MLB"), number), link)


def item_number(link: Column) -> Column:
    return first_group(link, r"/item/([0-9]+)\.html")


def shop_and_item(link: Column) -> tuple[Column, Column]:
    pattern = "/([0-9]+)/([0-9]+)"
    return F.regexp_extract(link, pattern, 1), F.regexp_extract(link, pattern, 2)


def absolute(url: Column, base: str, bare_prefix: str | None = None) -> Column:
    """P19. ``//x`` gets https, ``/x`` the base; other relative forms get ``bare_prefix``."""
    made = F.when(url.startswith("http"), url).when(
        url.startswith("//"), F.concat(F.lit("https:"), url)
    ).when(url.startswith("/"), F.concat(F.lit(base), url))
    if bare_prefix is None:
        return made.otherwise(url)
    return made.when(url != "", F.concat(F.lit(bare_prefix), url)).otherwise(url)


def larger_image(url: Column) -> Column:
    """P21. Ask for the larger picture by rewriting the size part of its name."""
    unsized = F.regexp_replace(url, r"\._[A-Z]{2}[0-9]+_\.", ".")
    return F.regexp_replace(unsized, r"\._AC_[^.]+\.", "._AC_SX679_.")


def original_thumbnail(url: Column) -> Column:
    """P21. The original behind a thumbnail name."""
    return F.regexp_replace(url, r"-[A-Z]\.jpg$", "-O.jpg")


def cdn_image(image_id: Column) -> Column:
    """P21. CDN address of an image id."""
    return F.coalesce(
        F.concat(F.lit("https://down-br.img.susercontent.com/file/"), non_empty(image_id)), F.lit(""))


def is_image_url(url: Column) -> Column:
    """F7. A web address that looks like a picture and is no placeholder."""
    shape = url.rlike(r"(?i)\.(jpe?g|png|webp|gif)(\?|$)") | url.rlike("(?i)/(image|photo|img|media)/")
    return F.coalesce(
        url.startswith("http") & ~F.contains(F.lower(url), F.lit("placeholder")) & shape, F.lit(False))


def on_domain(link: Column, domain: str) -> Column:
    """F8. The link mentions the domain."""
    return F.coalesce(F.contains(link, F.lit(domain)), F.lit(False))
