"""Column functions over titles and free text.

Java's ``\\s`` and ``\\w`` are ASCII only, so patterns here spell out ``[\\s\\p{Z}]``,
``\\p{L}`` and ``\\p{N}``; accented Portuguese letters survive that way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from vitrine import fixed_values as fv

SPACE = r"[\s\p{Z}]"
# fixed values: the characters that count as white space at the ends of a text
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only the ASCII blank."""
    return F.btrim(text, F.lit(BLANKS))


def non_empty(text: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(text, F.lit(""))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null when the pattern is absent or the group is empty."""
    return non_empty(F.regexp_extract(text, pattern, group))


def parse_price(text: Column, thousands_dot: bool = False) -> Column:
    """P4. Price text to DOUBLE, null when it is not a number.

    A comma next to a dot makes the dot a thousands mark; a dot on its own is a decimal point
    unless ``thousands_dot`` is set and the digits group in threes.
    """
    digits = F.regexp_replace(text, "[^0-9,.]", "")
    if thousands_dot:
        digits = F.when(
            digits.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$"), F.replace(digits, F.lit("."), F.lit(""))
        ).otherwise(digits)
    plain = F.when(F.contains(digits, F.lit(",")), F.translate(digits, ",.", ".")).otherwise(digits)
    return plain.try_cast("double")


def price_in_text(text: Column) -> Column:
    """P5. The first ``R$ 1.234,56`` inside free text."""
    return parse_price(F.regexp_extract(text, rf"R\${SPACE}*([0-9.]+,[0-9]{{2}})", 1))


def percent_in_text(text: Column, need_sign: bool = True) -> Column:
    """P9. The first integer (before a percent sign when ``need_sign``)."""
    return F.regexp_extract(text, rf"([0-9]+){SPACE}*%" if need_sign else "([0-9]+)", 1).try_cast("double")


def clean_title(title: Column) -> Column:
    """P11. Squeeze blanks, drop shop names and durations, drop dangling separators."""
    # one kind of blank is left after the first step, so plain trims do for the rest
    squeezed = F.regexp_replace(title, rf"{SPACE}+", " ")
    without_shops = reduce(
        lambda text, shop: F.replace(text, F.lit(shop), F.lit("")), fv.TITLE_STORE_NAMES, squeezed)
    without_time = F.regexp_replace(
        without_shops, "[0-9]+ *(min|h|d|dias?|horas?) *[0-9]* *(min|h|d)?", "")
    return F.ltrim(F.rtrim(without_time, F.lit(" |–-")))


def normalize_title(title: Column, keep_numbers: bool = False) -> Column:
    """P12. Comparison form: lower case, no punctuation, single blanks, no numbers."""
    letters = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s\p{Z}]", "")
    squeezed = F.trim(F.regexp_replace(letters, rf"{SPACE}+", " "))
    if keep_numbers:
        return squeezed
    return F.trim(F.regexp_replace(squeezed, r"r?\$? *[0-9]+[.,]?[0-9]*", ""))


def _usable_code(code: Column) -> Column:
    return F.when(F.length(code).between(3, 25) & ~code.rlike("^[0-9]+$"), code)


def coupon_in_title(title: Column) -> Column:
    """P22. A coupon code announced in a title; 3-25 characters, not a plain number."""
    upper = F.upper(title)
    announced = F.regexp_extract(
        upper, rf"(?:CUPOM|CÓD(?:IGO)?|COD(?:IGO)?|USE){SPACE}*:?{SPACE}*([A-Z0-9]{{3,25}})", 1)
    spelled = F.regexp_extract(
        upper, rf"(?:CUPOM|CÓDIGO|CODIGO){SPACE}+([A-Z0-9]+(?:[0-9]+|[0-9]+[A-Z]+))", 1)
    return F.coalesce(_usable_code(announced), _usable_code(spelled))


def coupon_in_label(label: Column) -> Column:
    """P22. A product label: the word after ``CUPOM``, else the whole label that mentions it."""
    return F.when(
        F.contains(F.upper(label), F.lit("CUPOM")),
        F.coalesce(first_group(label, rf"(?i)CUPOM{SPACE}+([^\s\p{{Z}}]+)"), strip(label)),
    )


def coupon_in_badge(badge: Column) -> Column:
    """P22. Badge text such as ``Cupom: SHARK20``; short texts are no coupon."""
    named = F.upper(first_group(badge, rf"(?i)(?:cupom|código){SPACE}*:?{SPACE}*([A-Z0-9]+)"))
    return F.coalesce(named, F.when(F.length(badge) >= 3, badge))


def coupon_in_offer_badge(badge: Column) -> Column:
    """P22. A badge that speaks of a discount: its code, else a fixed hint."""
    speaks = F.lower(badge).rlike("cupom|coupon|desconto|off|%")
    code = first_group(F.upper(badge), "[A-Z0-9]{4,20}", 0)
    return F.when(speaks, F.coalesce(code, F.lit("Ative na página")))


def mentions_free_shipping(text: Column, phrases=("frete grátis",)) -> Column:
    """P23. Any of the phrases occurs in the text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in phrases])


def brl(amount: Column) -> Column:
    """P27. ``R$ 1.299,90``."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(amount, 2), ",.", ".,"))


def escape_marks(text: Column) -> Column:
    """P32. Escape underscores for the message mark-up."""
    return F.replace(text, F.lit("_"), F.lit("\\_"))


def cut(text: Column, limit: int, tail: str) -> Column:
    """P31. Text within ``limit`` characters, the cut marked by ``tail``."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - len(tail)), F.lit(tail)))


def amount_or_na(amount: Column) -> Column:
    """P38. ``R$12.34`` in reports, ``N/A`` for a missing or zero price."""
    shown = F.concat(F.lit("R$"), F.replace(F.format_number(amount, 2), F.lit(","), F.lit("")))
    return F.when(amount != 0, shown).otherwise("N/A")


def rate_text(part: Column, whole: Column) -> Column:
    """P35. ``12.5%``; an empty whole gives ``0.0%``."""
    share = F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100
    return F.format_string("%.1f%%", share)


def deal_title(percent: Column) -> Column:
    """P37. Title of a deal that came without one."""
    return F.when(
        percent != 0, F.format_string("Super Deal -%.0f%% OFF", percent)
    ).otherwise("Super Deal AliExpress")


def text_list(text: Column) -> Column:
    """SC20. Comma-separated settings text to a clean array."""
    return F.filter(F.transform(F.split(text, ","), lambda item: F.trim(item)), lambda item: item != "")
