"""Column functions over prices. Money is DECIMAL(12,2), percent DECIMAL(6,1), half-up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vitrine.schemas import MONEY, PERCENT


def money(value: Column) -> Column:
    return value.try_cast(MONEY)


def has_discount(price: Column, list_price: Column) -> Column:
    """P1. Both prices are there and list price > price > 0."""
    return F.coalesce((list_price > price) & (price > 0), F.lit(False))


def percent_off(price: Column, list_price: Column) -> Column:
    """P10. Discount between two prices, one decimal; null without a usable list price."""
    price, list_price = money(price), money(list_price)
    return F.round(F.try_divide((list_price - price) * 100, list_price), 1).try_cast(PERCENT)


def calculated_discount(price: Column, list_price: Column, declared: Column) -> Column:
    """P2. Percent from the prices, else the declared one."""
    return F.when(has_discount(price, list_price), percent_off(price, list_price)).otherwise(
        declared.try_cast(PERCENT))


def savings(price: Column, list_price: Column) -> Column:
    """P3. Amount saved, null without a discount."""
    return F.when(has_discount(price, list_price), money(money(list_price) - money(price)))


def from_scaled(raw: Column, scale: int = 100000) -> Column:
    """P6. Integer price in 1/scale units."""
    return raw.try_cast("decimal(20,0)") / F.lit(scale)


def non_zero(value: Column) -> Column:
    """P7. Zero and unreadable numbers count as missing; negatives stay."""
    number = value.try_cast("double")
    return F.when(number != 0, number)


def positive(value: Column) -> Column:
    """P7. Only numbers above zero survive."""
    number = value.try_cast("double")
    return F.when(number > 0, number)


def usable_list_price(price: Column, list_price: Column) -> Column:
    """P8. A list price that is not above the price says nothing. Without a price it stays."""
    return F.when(price.isNull() | (price == 0) | (list_price > price), list_price)
