"""Checks on the star schema. Each is one DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import table_kind
from shelfmark.operators.lookup import Dimension
from shelfmark.plans.schema import LINE_DIMENSIONS

# Which fact column refers to which dimension key.
SALES_REFERENCES = (
    ("customer_key", "dim_customer", "customer_key"),
    ("product_key", "dim_product", "product_key"),
    ("geography_key", "dim_geography", "geography_key"),
    ("ship_mode_key", "dim_ship_mode", "ship_mode_key"),
    ("order_date_key", "dim_date", "date_key"),
    ("ship_date_key", "dim_date", "date_key"),
)


def table_inventory(layers: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """(layer, table, kind, rows, columns) of all tables, counted in one job."""
    return _union(
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(layer).alias("layer"),
            F.lit(name).alias("table"),
            table_kind(F.lit(name)).alias("kind"),
            "rows",
            F.lit(len(df.columns)).alias("columns"),
        )
        for layer, tables in layers.items()
        for name, df in tables.items()
    )


def duplicate_keys(
    dims: Mapping[str, DataFrame], dimensions: Iterable[Dimension] = LINE_DIMENSIONS
) -> DataFrame:
    """Business keys that own more than one dimension row, as text."""
    return _union(
        dims[d.table]
        .groupBy(*d.business)
        .agg(F.count(F.lit(1)).alias("versions"))
        .where("versions > 1")
        .select(
            F.lit(d.table).alias("dimension"),
            F.concat_ws(
                "|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in d.business]
            ).alias("business_key"),
            "versions",
        )
        for d in dimensions
    )


def key_clashes(
    dims: Mapping[str, DataFrame], dimensions: Iterable[Dimension] = LINE_DIMENSIONS
) -> DataFrame:
    """Surrogate keys on more than one row; empty in a sound star schema."""
    return _union(
        dims[d.table]
        .groupBy(F.col(d.key).alias("key"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
        .select(F.lit(d.table).alias("dimension"), "key", "rows")
        for d in dimensions
    )


def orphan_facts(star: Mapping[str, DataFrame]) -> DataFrame:
    """Fact rows per reference: all, without a key, and with a key no dimension row has.

    Rows are counted per key first; only the distinct keys meet the dimension.
    """
    return _union(_references(star, *reference) for reference in SALES_REFERENCES)


def _references(star: Mapping[str, DataFrame], column: str, table: str, key: str) -> DataFrame:
    used = star["fact_sales"].groupBy(F.col(column).alias("_key")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    # a repeated NULL key in the dimension never matches; distinct keeps one row per key
    present = star[table].select(F.col(key).alias("_key"), F.lit(True).alias("_found")).distinct()
    counted = used.join(present, "_key", "left")
    missing = F.col("_key").isNull()
    return counted.agg(
        F.sum("_rows").alias("fact_rows"),
        F.sum(F.when(missing, F.col("_rows")).otherwise(0)).alias("rows_without_key"),
        F.sum(
            F.when(~missing & F.col("_found").isNull(), F.col("_rows")).otherwise(0)
        ).alias("orphan_rows"),
    ).select(
        F.lit(column).alias("reference"),
        F.lit(table).alias("dimension"),
        "fact_rows",
        "rows_without_key",
        "orphan_rows",
    )


def manager_fanout(star: Mapping[str, DataFrame]) -> DataFrame:
    """Regions whose sales would be counted for no manager or for several."""
    managers = (
        star["dim_regional_manager"]
        .where(F.col("region").isNotNull())
        .groupBy("region")
        .agg(F.count(F.lit(1)).alias("managers"))
    )
    regions = star["dim_geography"].select("region").distinct()
    return (
        regions.join(managers, "region", "left")
        .select("region", F.coalesce("managers", F.lit(0)).alias("managers"))
        .where("managers <> 1")
    )


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
