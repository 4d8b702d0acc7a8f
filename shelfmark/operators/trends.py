"""Year-over-year comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.measures import growth_pct


def previous_year(
    df: DataFrame,
    series: Sequence[str],
    measures: dict[str, tuple[str, str]],
    strict: bool = False,
) -> DataFrame:
    """Add previous value and growth percent per series.

    ``measures`` maps value column -> (previous column, growth column). The
    previous row is the last year present; with ``strict`` only year - 1 counts.
    A series holds one row per year, so no window group grows with the data.
    """
    years = Window.partitionBy(*series).orderBy("year")
    adjacent = F.lag("year").over(years) == F.col("year") - 1
    lagged = {}
    for value, (previous, _) in measures.items():
        last = F.lag(value).over(years)
        lagged[previous] = F.when(adjacent, last) if strict else last
    grown = {growth: growth_pct(value, prev) for value, (prev, growth) in measures.items()}
    return df.withColumns(lagged).withColumns(grown)
