"""The two fact tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import date_key, ratio
from shelfmark.operators import attach_key, surrogate_key
from shelfmark.operators.bloom import might_contain
from shelfmark.operators.statistics import known_bytes
from shelfmark.plans.schema import (
    CUSTOMER,
    LINE_DIMENSIONS,
    PRODUCT,
    RETURN_COLUMNS,
    SALES_COLUMNS,
)

SLICE = 192 * 1024 * 1024  # of the rows of orders, unpacked, whose returns one task looks up


def fact_sales(
    orders: DataFrame,
    dims: Mapping[str, DataFrame],
    lookup: str = "as_is",
    method: str = "inline",
    null_safe_geography: bool = False,
) -> DataFrame:
    """One row per order line and matching dimension rows.

    ``dims`` maps table name -> dimension. With the default lookup method the
    rows are only projected: no exchange unless business keys have versions.
    ``sales_key`` numbers the rows of one execution; it is fixed once written.
    """
    lines = orders
    for dim in LINE_DIMENSIONS:
        lines = attach_key(
            lines,
            dims[dim.table],
            dim,
            lookup=lookup,
            method=method,
            null_safe=null_safe_geography and dim.table == "dim_geography",
        )
    return lines.withColumns(
        {
            "sales_key": F.monotonically_increasing_id() + 1,
            "order_date_key": date_key("order_date"),
            "ship_date_key": date_key("ship_date"),
            "revenue": F.col("sales"),
            "cost": F.col("sales") - F.col("profit"),
            # sales of 0 or NULL count as margin 0
            "profit_margin": F.when(F.col("sales") != 0, ratio("profit", "sales")).otherwise(0.0),
        }
    ).select(*SALES_COLUMNS)


def fact_returns(
    orders: DataFrame,
    returns: DataFrame,
    dims: Mapping[str, DataFrame],
    lookup: str = "as_is",
    method: str = "inline",
) -> DataFrame:
    """One row per return and distinct line of the returned order.

    A return of an unknown order stays, with NULL keys. A Bloom filter of the
    returned order ids, sized from the returns, lets (about) only their lines
    into the shuffle. These meet the returns by order id, and their distinct
    lines are taken where they then are; a return says how often it was made, so
    repeated ones do not multiply lines before. Returns that met none are found
    against the same rows. Lines are dealt over as many tasks as their table has
    slices of SLICE bytes, so what a task sorts and holds does not grow with it.
    """
    size = known_bytes(orders)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows if size is None or size <= SLICE else rows.repartition(size // SLICE + 1, "order_id")

    returned = returns.where(F.col("returned") == "Yes")
    returned = dealt(returned.select("order_id")).groupBy("order_id").agg(F.count(F.lit(1)).alias("_times"))

    own = {dim.key: f"_{dim.key}" for dim in (CUSTOMER, PRODUCT)}
    may = orders.where(might_contain(returns.where(F.col("returned") == "Yes"), "order_id", F.col("order_id")))
    columns = ("order_id", "customer_id", "product_id", "order_date", "region")
    lines = may.select(*columns, *[surrogate_key(dim.attributes).alias(own[dim.key]) for dim in (CUSTOMER, PRODUCT)])
    met = dealt(lines).join(returned, "order_id")
    found = met.groupBy(*columns, "_times").agg(*[F.min(k).alias(k) for k in own.values()])
    for dim in (CUSTOMER, PRODUCT):
        found = attach_key(
            found,
            dims[dim.table],
            dim,
            lookup=lookup,
            method=method,
            own_key=F.col(own[dim.key]),
        )
    columns = [c for c in RETURN_COLUMNS if c != "return_key"]
    found = found.withColumn("order_date_key", date_key("order_date")).select(*columns, "_times")

    empty = {c: F.lit(None).cast(found.schema[c].dataType) for c in columns if c != "order_id"}
    lost = returned.join(met.select("order_id"), "order_id", "left_anti").withColumns(empty)
    every = found.unionByName(lost.select(*columns, "_times"))
    every = every.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))

    return every.select((F.monotonically_increasing_id() + 1).alias("return_key"), *columns)
