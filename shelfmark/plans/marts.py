"""The seven business marts.

Facts are reduced before they meet a large dimension: where the mart's grain is
a dimension key, the aggregate runs on the key and the attributes join the
result; where it is a coarser attribute, the aggregate decides by the measured
size of the dimension.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import band, guarded_ratio, ratio
from shelfmark.functions.measures import (
    Measure,
    averaged,
    counted_units,
    greatest,
    least,
    summed,
)
from shelfmark.operators import (
    Grouping,
    Lookup,
    aggregate_by_key,
    global_rank,
    previous_year,
    share_of_total,
    stage,
)
from shelfmark.operators.lookup import BROADCAST_BYTES
from shelfmark.plans.schema import LOWEST_TIER, LTV_TIERS

Tables = Mapping[str, DataFrame]


def months(t: Tables) -> Grouping:
    return Grouping(
        t["fact_sales"].withColumn("_discounted", F.col("revenue") * F.col("discount")),
        ["year", "month", "month_name"],
        {
            "total_revenue": summed("revenue"),
            "total_profit": summed("profit"),
            "total_cost": summed("cost"),
            "total_units_sold": counted_units("quantity"),
            "avg_line_item_value": averaged("revenue"),
            "avg_discount": averaged("discount"),
            "avg_profit_margin": averaged("profit_margin"),
            "total_discount_amount": summed("_discounted"),
        },
        {"total_orders": "order_id"},
        [_ordered_in(t, "year", "month", "month_name")],
    )


def monthly_sales(t: Tables, by_month: DataFrame | None = None) -> DataFrame:
    """Measures per year and month.

    As with the other marts, finished groups may be handed in; they are
    aggregated from the fact otherwise.
    """
    by_month = months(t).aggregated() if by_month is None else by_month
    return by_month.select(
        "year",
        "month",
        "month_name",
        "total_revenue",
        "total_profit",
        "total_cost",
        "total_orders",
        "total_units_sold",
        "avg_line_item_value",
        "avg_discount",
        "avg_profit_margin",
        "total_discount_amount",
        ratio("total_revenue", "total_orders").alias("revenue_per_order"),
        ratio("total_profit", "total_orders").alias("profit_per_order"),
    )


def customers(t: Tables) -> Grouping:
    return Grouping(
        _with_date(t["fact_sales"], t["dim_date"], "date"),
        ["customer_key"],
        {
            "lifetime_revenue": summed("revenue"),
            "lifetime_profit": summed("profit"),
            "total_units_purchased": counted_units("quantity"),
            "avg_order_value": averaged("revenue"),
            "first_order_date": least("date"),
            "last_order_date": greatest("date"),
            "avg_discount_received": averaged("discount"),
        },
        {"total_orders": "order_id"},
        counted=t["fact_sales"],
    )


def customer_lifetime_value(
    t: Tables,
    tiers: Sequence[tuple[str, float]] = LTV_TIERS,
    lowest: str = LOWEST_TIER,
    spend: DataFrame | None = None,
) -> DataFrame:
    """Spend, frequency, returns, tenure and tier per customer row."""
    spend = customers(t).aggregated() if spend is None else spend
    # orders returned, not return rows
    returned = t["fact_returns"].groupBy("customer_key").agg(
        F.count_distinct("order_id").alias("_returns")
    )
    people = t["dim_customer"].select("customer_key", "customer_id", "customer_name", "segment")
    measured = (
        spend.join(returned, "customer_key", "left")
        .join(people, "customer_key", "left")
        .withColumn("total_returns", F.coalesce("_returns", F.lit(0)))
    )
    return measured.select(
        "customer_key",
        "customer_id",
        "customer_name",
        "segment",
        "lifetime_revenue",
        "lifetime_profit",
        "total_orders",
        "total_units_purchased",
        "avg_order_value",
        "first_order_date",
        "last_order_date",
        "avg_discount_received",
        "total_returns",
        ratio("total_returns", "total_orders").alias("return_rate"),
        F.datediff("last_order_date", "first_order_date").alias("customer_tenure_days"),
        band("lifetime_revenue", tiers, lowest).alias("ltv_tier"),
    )


def products(t: Tables) -> Grouping:
    return Grouping(
        t["fact_sales"],
        ["product_key"],
        {
            "total_revenue": summed("revenue"),
            "total_profit": summed("profit"),
            "total_units_sold": counted_units("quantity"),
            "avg_profit_margin": averaged("profit_margin"),
            "avg_discount": averaged("discount"),
        },
        {"total_orders": "order_id"},
    )


def product_sales(t: Tables, sold: DataFrame | None = None) -> DataFrame:
    """Measures and returns per product row, without the ranks."""
    if sold is None:
        # lines are stored by order: a task sees few lines of a product
        sold = products(t)
        sold = aggregate_by_key(sold.rows, "product_key", sold.measures, "total_orders", sold.distinct["total_orders"])
    # return rows, not orders
    returned = t["fact_returns"].groupBy("product_key").agg(
        F.count("return_key").alias("_returns")
    )
    items = t["dim_product"].select(
        "product_key", "product_id", "product_name", "category", "sub_category"
    )
    measured = (
        sold.join(returned, "product_key", "left")
        .join(items, "product_key", "left")
        .withColumn("total_returns", F.coalesce("_returns", F.lit(0)))
    )
    return measured.select(
        *items.columns,
        "total_revenue",
        "total_profit",
        "total_units_sold",
        "total_orders",
        "avg_profit_margin",
        "avg_discount",
        "total_returns",
        guarded_ratio("total_returns", "total_orders").alias("return_rate"),
    )


def product_performance(t: Tables, sold: DataFrame | None = None, **ranking) -> DataFrame:
    """Product measures with their place by revenue and by profit."""
    staged = stage(product_sales(t, sold), "product_sales")
    ranks = {"total_revenue": "revenue_rank", "total_profit": "profit_rank"}
    return global_rank(staged, ranks, **ranking)


_PLACE_COUNTS = {"total_orders": "order_id", "total_customers": "customer_key"}


def _place_measures() -> dict[str, Measure]:
    return {
        "total_revenue": summed("revenue"),
        "total_profit": summed("profit"),
        "total_cost": summed("cost"),
        "total_units_sold": counted_units("quantity"),
        "avg_profit_margin": averaged("profit_margin"),
        "avg_discount": averaged("discount"),
    }


def regions(t: Tables) -> Grouping:
    places = t["dim_geography"].select("geography_key", "region")
    return Grouping(
        t["fact_sales"], ["region"], _place_measures(), _PLACE_COUNTS, [Lookup("geography_key", places)]
    )


def regional_summary(
    t: Tables, max_broadcast_bytes: int = BROADCAST_BYTES, by_region: DataFrame | None = None
) -> DataFrame:
    """Measures per region and manager; a region with two managers counts for each.

    Managers join the finished regions. A manager listed n times for a region
    meets each of its lines n times, so sums count n-fold.
    """
    by_region = regions(t).aggregated(max_broadcast_bytes) if by_region is None else by_region
    managers = t["dim_regional_manager"].select("manager_name", F.col("region").alias("_region"))
    managers = managers.groupBy("manager_name", "_region").agg(F.count(F.lit(1)).alias("_times"))
    by_region = by_region.join(managers, F.col("region") == F.col("_region"), "left")
    sums = ("total_revenue", "total_profit", "total_cost", "total_units_sold")
    by_region = by_region.withColumns({c: F.col(c) * F.coalesce("_times", F.lit(1)) for c in sums})
    return by_region.select(
        "region",
        "manager_name",
        "total_revenue",
        "total_profit",
        "total_cost",
        "total_orders",
        "total_customers",
        "total_units_sold",
        "avg_profit_margin",
        "avg_discount",
        ratio("total_revenue", "total_customers").alias("revenue_per_customer"),
        ratio("total_profit", "total_customers").alias("profit_per_customer"),
    )


def categories(t: Tables) -> Grouping:
    items = t["dim_product"].select("product_key", "category", "sub_category")
    return Grouping(
        t["fact_sales"],
        ["year", "quarter", "category", "sub_category"],
        {
            "total_revenue": summed("revenue"),
            "total_profit": summed("profit"),
            "total_units_sold": counted_units("quantity"),
            "avg_profit_margin": averaged("profit_margin"),
        },
        {"total_orders": "order_id"},
        [_ordered_in(t, "year", "quarter"), Lookup("product_key", items)],
    )


def category_trends(
    t: Tables,
    strict_year: bool = False,
    max_broadcast_bytes: int = BROADCAST_BYTES,
    quarterly: DataFrame | None = None,
) -> DataFrame:
    """Measures per quarter and sub-category, with change against the year before."""
    quarterly = categories(t).aggregated(max_broadcast_bytes) if quarterly is None else quarterly
    return previous_year(
        quarterly,
        ["quarter", "category", "sub_category"],
        {
            "total_revenue": ("prev_year_revenue", "yoy_revenue_growth"),
            "total_profit": ("prev_year_profit", "yoy_profit_growth"),
        },
        strict=strict_year,
    ).select(
        "year",
        "quarter",
        "category",
        "sub_category",
        "total_revenue",
        "total_profit",
        "total_units_sold",
        "total_orders",
        "avg_profit_margin",
        "prev_year_revenue",
        "yoy_revenue_growth",
        "prev_year_profit",
        "yoy_profit_growth",
    )


def ship_modes(t: Tables) -> Grouping:
    modes = t["dim_ship_mode"].select("ship_mode_key", "ship_mode", "ship_mode_description")
    ordered = _with_date(t["fact_sales"], t["dim_date"], "date").withColumnRenamed("date", "_from")
    shipped = _with_date(ordered, t["dim_date"], "date", on="ship_date_key")
    return Grouping(
        shipped.withColumn("_days", F.datediff("date", "_from")),
        ["ship_mode", "ship_mode_description"],
        {
            "total_revenue": summed("revenue"),
            "total_profit": summed("profit"),
            "total_units_shipped": counted_units("quantity"),
            "avg_delivery_days": averaged("_days"),
            "min_delivery_days": least("_days"),
            "max_delivery_days": greatest("_days"),
            "avg_profit_margin": averaged("profit_margin"),
        },
        {"total_orders": "order_id"},
        [Lookup("ship_mode_key", modes)],
        counted=t["fact_sales"],
    )


def shipping_analysis(t: Tables, by_mode: DataFrame | None = None) -> DataFrame:
    """Measures, delivery days and shares per ship mode.

    Shares of orders refer to the sum of the modes' order counts.
    """
    by_mode = ship_modes(t).aggregated() if by_mode is None else by_mode
    by_mode = by_mode.select(
        "ship_mode",
        "ship_mode_description",
        "total_revenue",
        "total_profit",
        "total_orders",
        "total_units_shipped",
        "avg_delivery_days",
        "min_delivery_days",
        "max_delivery_days",
        "avg_profit_margin",
    )
    shares = {"total_revenue": "revenue_share_pct", "total_orders": "order_share_pct"}
    return share_of_total(stage(by_mode, "ship_modes"), shares)


def states(t: Tables) -> Grouping:
    places = t["dim_geography"].select("geography_key", "country", "state", "region")
    return Grouping(
        _with_date(t["fact_sales"], t["dim_date"], "date"),
        ["country", "state", "region"],
        {
            **_place_measures(),
            "first_order_date": least("date"),
            "last_order_date": greatest("date"),
        },
        _PLACE_COUNTS,
        [Lookup("geography_key", places)],
        counted=t["fact_sales"],
    )


def state_performance(
    t: Tables,
    max_broadcast_bytes: int = BROADCAST_BYTES,
    by_state: DataFrame | None = None,
    **ranking,
) -> DataFrame:
    """Measures, density ratios and revenue place per state."""
    by_state = states(t).aggregated(max_broadcast_bytes) if by_state is None else by_state
    by_state = by_state.select(
        "country",
        "state",
        "region",
        "total_revenue",
        "total_profit",
        "total_cost",
        "total_orders",
        "total_customers",
        "total_units_sold",
        "avg_profit_margin",
        "avg_discount",
        "first_order_date",
        "last_order_date",
        ratio("total_revenue", "total_customers").alias("revenue_per_customer"),
        ratio("total_orders", "total_customers").alias("orders_per_customer"),
        ratio("total_revenue", "total_orders").alias("avg_order_value"),
        guarded_ratio("total_profit", "total_cost").alias("profit_to_cost_ratio"),
    )
    staged = stage(by_state, "state_sales")
    return global_rank(staged, {"total_revenue": "state_revenue_rank"}, **ranking)


def _ordered_in(t: Tables, *attributes: str) -> Lookup:
    dates = t["dim_date"].select(F.col("date_key").alias("order_date_key"), *attributes)
    return Lookup("order_date_key", dates)


def _with_date(
    fact: DataFrame, dates: DataFrame, *attributes: str, on: str = "order_date_key"
) -> DataFrame:
    """Left join of calendar attributes (one row per day, so the dimension stays small)."""
    named = dates.select(F.col("date_key").alias("_date_key"), *attributes)
    return fact.join(named, F.col(on) == F.col("_date_key"), "left").drop("_date_key")
