"""Display labels for report figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_label(col: Column | str) -> Column:
    """``$1,234``; a negative amount is ``$-1,234``."""
    return F.concat(F.lit("$"), F.format_number(col, 0))


def percent_label(col: Column | str) -> Column:
    return _one_decimal(col, "%")


def days_label(col: Column | str) -> Column:
    return _one_decimal(col, "d")


def _one_decimal(col: Column | str, suffix: str) -> Column:
    return F.concat(F.format_string("%.1f", col), F.lit(suffix))
