"""Raw retail tables over a normalised order schema.

``lineitem orders customer nation region part supplier`` Parquet tables become
the flat ``orders``, ``returns`` and ``people`` raw tables that the star schema
is built from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which ship mode an order priority stands for; others keep their name.
SHIP_MODE_OF_PRIORITY = {
    "1-URGENT": "Same Day",
    "2-HIGH": "First Class",
    "3-MEDIUM": "Second Class",
    "4-NOT SPECIFIED": "Standard Class",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line, all attributes on it.

    Everything an order knows is joined before the lines are, so the wide
    customer lookup runs on orders, not on lines. Left joins keep every line
    and leave the line side splittable when a key is skewed. Money is exact
    decimal.

    Lines meet their parts first: they move twice, and what they carry the
    second time is narrower for a part than for an order. They end up together
    by order, so what an order knows is stored in runs, and counts of orders
    shrink to about one row per order and group before they move.
    """
    region = _table(spark, folder, "region")
    nation = _table(spark, folder, "nation").join(
        region, F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    customer = _table(spark, folder, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    orders = _table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    # cents and days take half the bytes of doubles and timestamps in a shuffle
    lines = _table(spark, folder, "lineitem").withColumns(
        {
            "l_extendedprice": F.col("l_extendedprice").cast("decimal(12,2)"),
            "l_discount": F.col("l_discount").cast("decimal(4,2)"),
            "l_shipdate": F.col("l_shipdate").cast("date"),
        }
    )
    lines = lines.join(_table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    lines = lines.withColumn("p_retailprice", F.col("p_retailprice").cast("decimal(12,2)"))
    lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")

    ship_mode = F.col("o_orderpriority")
    for priority, mode in SHIP_MODE_OF_PRIORITY.items():
        ship_mode = F.when(F.col("o_orderpriority") == priority, mode).otherwise(ship_mode)
    sales = F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))
    cost = F.expr("0.6BD * p_retailprice * cast(l_quantity as decimal(6,0))")
    return lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("l_shipdate").alias("ship_date"),
        ship_mode.alias("ship_mode"),
        F.col("o_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.lit("World").alias("country/region"),
        F.col("n_name").alias("city"),
        F.col("n_name").alias("state/province"),
        F.col("n_nationkey").cast("string").alias("postal_code"),
        F.col("r_name").alias("region"),
        F.col("l_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
        F.col("p_name").alias("product_name"),
        sales.cast("decimal(18,4)").alias("sales"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_discount").alias("discount"),
        (sales - cost).cast("decimal(18,4)").alias("profit"),
    )


def raw_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Yes for an order with a returned line, else No."""
    lines = _table(spark, folder, "lineitem")
    returned = F.max(F.coalesce(F.col("l_returnflag") == "R", F.lit(False)))
    return lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.when(returned, "Yes").otherwise("No").alias("returned")
    ).select("returned", "order_id")


def raw_people(spark: SparkSession, folder: str) -> DataFrame:
    """One manager per region: its first supplier by name."""
    placed = (
        _table(spark, folder, "supplier")
        .join(_table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return placed.groupBy(F.col("r_name").alias("region")).agg(
        F.min("s_name").alias("regional_manager")
    ).select("regional_manager", "region")
