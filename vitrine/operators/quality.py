"""Predicates, and the quality gate that says why an offer is refused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vitrine import fixed_values as fv
from vitrine.functions import text
from vitrine.functions.pricing import calculated_discount
from vitrine.operators.keywords import first_keyword, with_first_rule


def is_valid_record(title: Column, link: Column, price: Column) -> Column:
    """F1. Title of ten characters, a web link, no price at or below zero."""
    return F.coalesce(
        (F.length(text.strip(title)) >= 10) & link.startswith("http") & (price.isNull() | (price > 0)),
        F.lit(False),
    )


def _hit(lowered: Column, words: Sequence[str] | Column) -> Column:
    return words if isinstance(words, Column) else first_keyword(lowered, words)


def _named(reason: str, detail: Column) -> Column:
    return F.concat(F.lit(f"{reason} ("), detail, F.lit(")"))


def _two_decimals(amount: Column) -> Column:
    return F.replace(F.format_number(amount, 2), F.lit(","), F.lit(""))


def refusal_reason(
    title: Column, link: Column, price: Column, *,
    min_price: float = fv.MIN_PRICE, max_price: float = fv.MAX_PRICE,
    min_title: int = fv.MIN_TITLE, blocked: Sequence[str] | Column | None = None,
    poor: Sequence[str] | Column = fv.LOW_QUALITY_WORDS, lowered: Column | None = None,
) -> Column:
    """F2. Why an offer is refused (first failing check), null when it passes.

    ``blocked=None`` takes the default words, an empty list blocks none. A column is the word found, as
    ``quality_gate`` gives it for lists that are tables. ``lowered`` is the title in lower case where that is at hand.
    """
    blocked = fv.BLOCKED_KEYWORDS if blocked is None else blocked
    lowered = F.lower(title) if lowered is None else lowered
    blocked_word, poor_word = _hit(lowered, blocked), _hit(lowered, poor)
    symbols = F.length(F.regexp_replace(title, _plain_characters(), ""))
    trimmed = text.strip(title)
    return (
        F.when(title.isNull() | (F.length(trimmed) < min_title), "titulo_curto")
        .when(~F.coalesce(link.startswith("http"), F.lit(False)), "link_invalido")
        .when(price < min_price, _named("preco_baixo", _two_decimals(price)))
        .when(price > max_price, _named("preco_alto", _two_decimals(price)))
        .when(blocked_word.isNotNull(), _named("palavra_bloqueada", blocked_word))
        .when(poor_word.isNotNull(), _named("baixa_qualidade", poor_word))
        .when(title.rlike("(?iu)" + "|".join(fv.SPAM_PATTERNS)), "spam_detectado")
        .when(symbols > F.length(title) * 0.3, "excesso_caracteres_especiais")
        .when(trimmed.rlike("(?iu)" + "|".join(fv.GENERIC_PATTERNS)), "titulo_generico")
    )


def _plain_characters() -> str:
    escaped = "".join("\\" + c if c in "-[]\\^&" else c for c in fv.PLAIN_SYMBOLS)
    return rf"[\p{{L}}\p{{N}}{escaped}]"


def reason_code(reason: Column) -> Column:
    """The reason without its detail."""
    return F.regexp_extract(reason, "^[a-z_]+", 0)


def quality_gate(offers: DataFrame, **limits) -> DataFrame:
    """Adds ``reason``; rows with a null reason pass, the others are the reject side output.

    The word lists ``blocked`` and ``poor`` may be tables of any length (keyword, priority).
    """
    lowered = offers.withColumn("_lowered", F.lower("title"))
    for name in ("blocked", "poor"):
        if isinstance(limits.get(name), DataFrame):
            lowered = with_first_rule(lowered, limits[name], "_lowered", f"_{name}")
            limits = {**limits, name: F.col(f"_{name}.keyword")}
    return lowered.withColumn("reason", refusal_reason(
        F.col("title"), F.col("link"), F.col("price"), lowered=F.col("_lowered"), **limits)).drop("_lowered", "_blocked", "_poor")


def real_discount(price: Column, list_price: Column, declared: Column,
                  threshold: float = fv.MIN_REAL_DISCOUNT) -> Column:
    """F3. The calculated or the declared discount reaches the threshold."""
    calculated = calculated_discount(price, list_price, declared)
    return F.coalesce(calculated >= threshold, F.lit(False)) | F.coalesce(
        declared >= threshold, F.lit(False))


def is_digital(title: Column, link: Column) -> Column:
    """F4. Films, books, subscriptions and the like, by words or link path."""
    words = "|".join(term.replace("-", r"\-") for term in fv.DIGITAL_TERMS)
    return F.lower(F.concat(title, F.lit(" "), link)).rlike(words) | link.rlike(
        "/(?:prime-video|kindle-dbs|music|audible)/")


def is_active(status: Column) -> Column:
    """F5. No status counts as active."""
    return F.coalesce(status, F.lit("active")).isin("active", "")
