"""Exact price arithmetic. Prices are whole units (bigint) or decimals; ratios go through decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RATIO = "decimal(20,2)"


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole with one decimal, halves away from zero."""
    return F.round((part * 100).cast(_RATIO) / whole.cast(_RATIO), 1).cast("double")


def percent_half_even(part: Column, whole: Column) -> Column:
    """100 * part / whole with one decimal, halves to the even digit."""
    return F.bround((part * 100).cast(_RATIO) / whole.cast(_RATIO), 1).cast("double")


def per_unit(price: Column, units: Column) -> Column:
    """Price per unit with one decimal, halves away from zero."""
    return F.round(price.cast(_RATIO) / units.cast(_RATIO), 1).cast("double")


def discounted(price: Column, list_price: Column) -> Column:
    return F.coalesce(list_price > price, F.lit(False))


def median_half_even(sorted_prices: Column) -> Column:
    """Median of a sorted array of whole prices, rounded half to even."""
    size = F.size(sorted_prices)
    low = F.element_at(sorted_prices, ((size + 1) / 2).cast("int"))
    high = F.element_at(sorted_prices, (size / 2).cast("int") + 1)
    total = low + high
    half = F.floor(total / 2)
    return F.when(total % 2 == 0, half).otherwise(half + half % 2)
