"""The six dimensions, from conformed raw tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import calendar_columns
from shelfmark.operators import surrogate_key
from shelfmark.operators.lookup import Dimension
from shelfmark.sources.rejects import read_date
from shelfmark.plans.schema import (
    CONFORMED,
    CUSTOMER,
    GEOGRAPHY,
    MANAGER,
    PRODUCT,
    SHIP_MODE,
    SHIP_MODE_TEXT,
    UNKNOWN_SHIP_MODE,
)


DATES = ("order_date", "ship_date")


def conform_orders(raw: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """Star-schema column names; text dates become timestamps by the first format that fits.

    Unreadable ones are NULL here; ``unread_dates`` counts them.
    """
    renamed = raw.withColumnsRenamed(CONFORMED)
    text_dates = [c for c, t in renamed.dtypes if c in DATES and t == "string"]
    return renamed.withColumns({c: read_date(F.col(c), formats) for c in text_dates})


def unread_dates(raw: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """(date_column, present, unread) of the dates of raw orders, from one pass."""
    kinds = dict(raw.dtypes)
    parts = []
    for c in DATES:
        text = kinds[c] == "string"
        there = F.col(c).isNotNull() & (F.btrim(F.col(c)) != "") if text else F.col(c).isNotNull()
        unread = there & read_date(F.col(c), formats).isNull() if text else F.lit(False)
        parts.append(F.struct(F.lit(c).alias("date_column"), F.count_if(there).alias("present"), F.count_if(unread).alias("unread")))
    return raw.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))


def distinct_dimension(orders: DataFrame, dim: Dimension) -> DataFrame:
    """Distinct attribute combinations with their key."""
    rows = orders.select(*dim.attributes).distinct()
    return rows.select(surrogate_key(dim.attributes).alias(dim.key), *dim.attributes)


def dim_customer(orders: DataFrame) -> DataFrame:
    return distinct_dimension(orders, CUSTOMER)


def dim_product(orders: DataFrame) -> DataFrame:
    return distinct_dimension(orders, PRODUCT)


def dim_geography(orders: DataFrame) -> DataFrame:
    return distinct_dimension(orders, GEOGRAPHY)


def dim_ship_mode(
    orders: DataFrame,
    text: Mapping[str, str] = SHIP_MODE_TEXT,
    default: str = UNKNOWN_SHIP_MODE,
) -> DataFrame:
    modes = distinct_dimension(orders, SHIP_MODE)
    return modes.withColumn("ship_mode_description", _lookup_text("ship_mode", text, default))


def dim_date(orders: DataFrame) -> DataFrame:
    """Every order or ship date once; a missing date is one NULL row.

    Both dates come from one pass over the orders.
    """
    both = F.array(F.col("order_date").cast("date"), F.col("ship_date").cast("date"))
    dates = orders.select(F.explode(both).alias("date")).distinct()
    named = calendar_columns("date")
    return dates.select(
        named.pop("date_key").alias("date_key"), "date", *[c.alias(n) for n, c in named.items()]
    )


def dim_regional_manager(people: DataFrame) -> DataFrame:
    """One row per person and region as given; repeated rows stay."""
    named = people.withColumnRenamed("regional_manager", "manager_name")
    return named.select(
        surrogate_key(MANAGER.attributes).alias(MANAGER.key), *MANAGER.attributes
    )


def _lookup_text(col: str, text: Mapping[str, str], default: str) -> Column:
    out = F.lit(default)
    for value, label in text.items():
        out = F.when(F.col(col) == value, label).otherwise(out)
    return out
