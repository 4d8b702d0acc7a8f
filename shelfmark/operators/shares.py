"""Share of a grand total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.measures import ratio


def share_of_total(df: DataFrame, shares: dict[str, str]) -> DataFrame:
    """Add value / total * 100 for each value column -> share column.

    The total is a one-row subquery, partially summed where the rows are; no
    window gathers the table. ``df`` is read twice, so hand in a staged frame.
    """
    for value, name in shares.items():
        grand = df.agg(F.sum(value)).scalar()
        df = df.withColumn(name, ratio(value, grand) * 100)
    return df
