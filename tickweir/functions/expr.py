"""Null-safe column expressions that stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def or_zero(x: Column) -> Column:
    return F.coalesce(known(x.cast("double")), F.lit(0.0))


def finite(x: Column) -> Column:
    """NaN, null and infinities as 0."""
    x = or_zero(x)
    return F.when(F.abs(x) == F.lit(float("inf")), 0.0).otherwise(x)


def ratio(num: Column, den: Column) -> Column:
    """num / den where den is positive, else null."""
    return F.when(den > 0, num / den)


def at(array: str, k: int) -> Column:
    """The k-th element, from 0; null beyond the end."""
    return F.get(F.col(array), F.lit(k))


def total(elements: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, elements)


def list_sum(array: str, n: int | None = None) -> Column:
    """The sum of an array's elements, or of its first n; null elements count 0, an empty array gives 0."""
    if n is not None:  # as text: one call to the JVM instead of one for every operation
        whole = " + ".join(f"coalesce(get(`{array}`, {k}), 0D)" for k in range(n))
        return F.expr(f"CASE WHEN `{array}` IS NOT NULL THEN {whole} END")
    return F.expr(f"aggregate(`{array}`, 0D, (s, x) -> s + coalesce(x, 0D))")


def dot(a: str, b: str, n: int) -> Column:
    """The sum of products of the first n elements of two arrays; pairs that lack one count 0."""
    whole = " + ".join(f"coalesce(get(`{a}`, {k}) * get(`{b}`, {k}), 0D)" for k in range(n))
    return F.expr(f"CASE WHEN `{a}` IS NOT NULL AND `{b}` IS NOT NULL THEN {whole} END")


def argmax(p: Column) -> Column:
    """The place, from 0, of the first of an array's greatest elements."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1
