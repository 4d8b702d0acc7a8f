"""Measure expressions shared by the marts and reports.

Money may arrive as decimal or double. Sums run in the arriving type, so
decimal input adds up exactly and independent of row order; results leave as
double.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("double")


def total(col: Column | str) -> Column:
    return _double(F.sum(col))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den; NULL where the denominator is 0 or NULL."""
    return F.try_divide(_double(num), _double(den))


def guarded_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den where den > 0, else 0."""
    return F.when(_double(den) > 0, ratio(num, den)).otherwise(F.lit(0.0))


def mean(col: Column | str) -> Column:
    """Unweighted mean of the non-NULL values (exact sum for decimals)."""
    return ratio(F.sum(col), F.count(col))


def growth_pct(current: str, previous: str) -> Column:
    """Change against previous in percent; NULL without a previous value."""
    return ratio(F.col(current) - F.col(previous), previous) * 100


def percent(col: Column | str, digits: int = 1) -> Column:
    """A fraction shown as rounded percent."""
    return F.round(_double(col) * 100, digits)


def band(col: str, floors: Sequence[tuple[str, float]], default: str) -> Column:
    """Label of the first floor reached, floors given from high to low."""
    limits = [f for _, f in floors]
    if limits != sorted(limits, reverse=True):
        raise ValueError("band floors must go from high to low")
    out = F.lit(default)
    for label, floor in reversed(floors):
        out = F.when(F.col(col) >= floor, label).otherwise(out)
    return out


@dataclass(frozen=True)
class Measure:
    """An aggregate that can be taken in one step, or in parts that are merged later.

    ``parts`` are aggregates over rows; ``merge`` aggregates the parts' columns,
    which may be kept in a table until then.
    """

    whole: Column
    parts: tuple[Column, ...]
    merge: Callable[..., Column]


def summed(col: Column | str) -> Measure:
    return Measure(total(col), (F.sum(col),), total)


def counted_units(col: str) -> Measure:
    """Sum that stays an integer."""
    return Measure(F.sum(col), (F.sum(col),), F.sum)


def averaged(col: str) -> Measure:
    return Measure(
        mean(col), (F.sum(col), F.count(col)), lambda s, n: ratio(F.sum(s), F.sum(n))
    )


def least(col: str) -> Measure:
    return Measure(F.min(col), (F.min(col),), F.min)


def greatest(col: str) -> Measure:
    return Measure(F.max(col), (F.max(col),), F.max)
