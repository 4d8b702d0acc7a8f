"""Report queries over the marts, one function per family.

Parameters cover what the reports of a family differ in: rounding digits
(None leaves the figure as it is), percent scaling, extra columns, order and
limit. Top-n reports break ties by the natural key, so their rows are fixed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import days_label, mean, money_label, percent, percent_label
from shelfmark.operators import share_of_total, stage


def rounded(col: Column | str, digits: int | None) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col if digits is None else F.round(col, digits)


def _margin(as_percent: bool, digits: int | None, col: Column | str = "avg_profit_margin") -> Column:
    """The margin as percent, or as the stored fraction."""
    return percent(col, digits) if as_percent else rounded(col, digits)


def _pick(df: DataFrame, columns: Mapping[str, Column | str], keep: Sequence[str] | None) -> DataFrame:
    names = list(columns) if keep is None else keep
    out = {n: columns[n] for n in names}
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in out.items()])


# --- monthly sales -----------------------------------------------------------


def kpi_totals(
    monthly: DataFrame,
    money: int | None = 0,
    margin: str = "avg_margin_pct",
    as_percent: bool = True,
    extended: bool = False,
) -> DataFrame:
    """Grand totals; the margin is the plain mean of the monthly margins."""
    out = {
        "total_revenue": rounded(F.sum("total_revenue"), money),
        "total_profit": rounded(F.sum("total_profit"), money),
        "total_orders": F.sum("total_orders"),
        margin: _margin(as_percent, 1, mean("avg_profit_margin")),
    }
    if extended:
        out["total_units"] = F.sum("total_units_sold")
        out["avg_order_value"] = rounded(mean("revenue_per_order"), money)
    return monthly.agg(*[c.alias(n) for n, c in out.items()])


def kpi_counters(monthly: DataFrame) -> DataFrame:
    """Unrounded figures of the counter tiles."""
    sums = ("total_revenue", "total_profit", "total_orders", "total_units_sold")
    means = ("avg_profit_margin", "revenue_per_order")
    return monthly.agg(
        *[F.sum(c).alias(c) for c in sums], *[mean(c).alias(c) for c in means]
    )


def monthly_trend(
    monthly: DataFrame,
    money: int | None = 2,
    text_year: bool = True,
    short_names: bool = True,
    extras: Sequence[str] = ("total_orders",),
    ratio_digits: tuple[int | None, int | None] = (1, 2),
) -> DataFrame:
    """Revenue and profit per month in calendar order, plus the extras asked for."""
    margin_digits, discount_digits = ratio_digits
    columns = {
        "total_orders": F.col("total_orders"),
        "total_units_sold": F.col("total_units_sold"),
        "avg_profit_margin": rounded("avg_profit_margin", margin_digits),
        "avg_discount": rounded("avg_discount", discount_digits),
        "revenue_per_order": rounded("revenue_per_order", money),
    }
    revenue, profit = ("revenue", "profit") if short_names else ("total_revenue", "total_profit")
    ordered = monthly.orderBy("year", "month")
    return ordered.select(
        _year(text_year),
        "month",
        "month_name",
        rounded("total_revenue", money).alias(revenue),
        rounded("total_profit", money).alias(profit),
        *[columns[e].alias(e) for e in extras],
    )


def monthly_all(monthly: DataFrame) -> DataFrame:
    return monthly.select("*")


def monthly_orders(monthly: DataFrame) -> DataFrame:
    """Order and unit volume per month."""
    return monthly.orderBy("year", "month").select(
        _year(True), "month", "month_name", "total_orders", "total_units_sold"
    )


def discount_margin(monthly: DataFrame) -> DataFrame:
    """Discount against margin, both in percent."""
    return monthly.orderBy("year", "month").select(
        _year(True),
        "month",
        percent("avg_discount").alias("avg_discount_pct"),
        percent("avg_profit_margin").alias("avg_margin_pct"),
    )


def yearly(monthly: DataFrame, money: int = 0, margin_digits: int = 1) -> DataFrame:
    return (
        monthly.groupBy("year")
        .agg(
            rounded(F.sum("total_revenue"), money).alias("annual_revenue"),
            rounded(F.sum("total_profit"), money).alias("annual_profit"),
            F.sum("total_orders").alias("annual_orders"),
            rounded(mean("avg_profit_margin"), margin_digits).alias("avg_margin"),
        )
        .orderBy("year")
    )


def monthly_by_year(monthly: DataFrame, years: Sequence[int], measure: str = "total_revenue") -> DataFrame:
    """One line per month, one column per year (the series of a line chart)."""
    pivoted = monthly.groupBy("month").pivot("year", list(years))
    return pivoted.agg(rounded(F.sum(measure), 2)).orderBy("month")


def calendar_years(dates: DataFrame) -> list[int]:
    """The years of a date dimension, which holds one row per day."""
    years = dates.select("year").where("year is not null").distinct()
    return sorted(r.year for r in years.collect())


def _year(text: bool) -> Column:
    return (F.col("year").cast("string") if text else F.col("year")).alias("year")


# --- regions -----------------------------------------------------------------


def regional(
    regions: DataFrame,
    money: int | None = 0,
    as_percent: bool = True,
    margin: str = "margin_pct",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Regions by revenue. ``keep`` picks and orders the columns shown."""
    columns = {
        "region": "region",
        "manager_name": "manager_name",
        "revenue": rounded("total_revenue", money),
        "profit": rounded("total_profit", money),
        "total_revenue": rounded("total_revenue", money),
        "total_profit": rounded("total_profit", money),
        "total_cost": rounded("total_cost", money),
        "total_orders": "total_orders",
        "total_customers": "total_customers",
        "rev_per_customer": rounded("revenue_per_customer", money),
        "revenue_per_customer": rounded("revenue_per_customer", money),
        margin: _margin(as_percent, 1 if money is not None else None),
    }
    by_revenue = regions.orderBy(
        F.desc_nulls_last(rounded("total_revenue", money)), "region", "manager_name"
    )
    return _pick(by_revenue, columns, keep)


def region_labels(regions: DataFrame) -> DataFrame:
    """Revenue labels of the region bars."""
    return regions.select(
        "region", "manager_name", money_label(F.round("total_revenue", 0)).alias("revenue_label")
    )


# --- customers ---------------------------------------------------------------


def segments(
    customers: DataFrame,
    money: int | None = None,
    revenue: str = "total_revenue",
    averages: bool = False,
) -> DataFrame:
    """Customers per segment; with ``money`` also their revenue, with averages on request."""
    out = {"customer_count": F.count(F.lit(1))}
    if money is not None:
        out[revenue] = rounded(F.sum("lifetime_revenue"), money)
    if averages:
        out["avg_revenue"] = rounded(mean("lifetime_revenue"), money)
        out["avg_orders"] = rounded(mean("total_orders"), 1)
    order = revenue if money is not None else "customer_count"
    grouped = customers.groupBy("segment").agg(*[c.alias(n) for n, c in out.items()])
    return grouped.orderBy(F.desc_nulls_last(order), "segment")


def segment_share(customers: DataFrame) -> DataFrame:
    """Percent of customers per segment (slices of a pie)."""
    counted = customers.groupBy("segment").agg(F.count(F.lit(1)).alias("customer_count"))
    shares = share_of_total(stage(counted, "segments"), {"customer_count": "share_pct"})
    return shares.withColumn("share_pct", F.round("share_pct", 1))


def ltv_tiers(
    customers: DataFrame,
    money: int = 0,
    revenue: str = "avg_revenue",
    orders: str | None = "avg_orders",
    order_value: bool = False,
) -> DataFrame:
    """Size and averages of the customer tiers, richest first."""
    out = {
        "customer_count": F.count(F.lit(1)),
        revenue: rounded(mean("lifetime_revenue"), money),
    }
    if orders:
        out[orders] = rounded(mean("total_orders"), 1)
    if order_value:
        out["avg_order_value"] = rounded(mean("avg_order_value"), money)
    grouped = customers.groupBy("ltv_tier").agg(*[c.alias(n) for n, c in out.items()])
    return grouped.orderBy(F.desc_nulls_last(revenue), "ltv_tier")


def top_customers(
    customers: DataFrame,
    n: int = 15,
    money: int | None = 0,
    revenue: str = "lifetime_revenue",
    order_value: str = "avg_order",
    extras: Sequence[str] = (),
) -> DataFrame:
    """Customers with the highest lifetime revenue."""
    columns = {
        "lifetime_profit": rounded("lifetime_profit", money),
        "return_rate_pct": percent("return_rate"),
        "return_rate": F.col("return_rate"),
        "customer_tenure_days": F.col("customer_tenure_days"),
    }
    top = customers.orderBy(
        F.desc_nulls_last(rounded("lifetime_revenue", money)), "customer_id", "customer_key"
    ).limit(n)
    return top.select(
        "customer_name",
        "segment",
        "ltv_tier",
        rounded("lifetime_revenue", money).alias(revenue),
        "total_orders",
        rounded("avg_order_value", money).alias(order_value),
        *[columns[e].alias(e) for e in extras],
    )


# --- products ----------------------------------------------------------------


def products(
    items: DataFrame,
    n: int,
    keep: Sequence[str],
    money: int | None = 0,
    by_rank: bool = False,
    as_percent: bool = True,
) -> DataFrame:
    """Top products by shown revenue, or by the stored revenue rank."""
    columns = {
        "revenue_rank": "revenue_rank",
        "product_name": "product_name",
        "category": "category",
        "sub_category": "sub_category",
        "revenue": rounded("total_revenue", money),
        "profit": rounded("total_profit", money),
        "total_revenue": rounded("total_revenue", money),
        "total_profit": rounded("total_profit", money),
        "total_units_sold": "total_units_sold",
        "units": "total_units_sold",
        "total_orders": "total_orders",
        "total_returns": "total_returns",
        "margin_pct": _margin(True, 1),
        "avg_profit_margin": _margin(as_percent, 1 if money is not None else None),
        "return_rate": "return_rate",
        "return_rate_pct": percent("return_rate"),
        "return_pct": percent("return_rate"),
    }
    first = (
        F.asc_nulls_last("revenue_rank")
        if by_rank
        else F.desc_nulls_last(rounded("total_revenue", money))
    )
    return _pick(items.orderBy(first, "product_id", "product_key").limit(n), columns, keep)


def worst_return_rates(items: DataFrame, n: int = 10) -> DataFrame:
    """Products with returns, highest return rate first."""
    returned = items.where("total_returns > 0")
    worst = returned.orderBy(F.desc_nulls_last("return_rate"), "product_id", "product_key")
    return worst.limit(n).select(
        "product_name", percent("return_rate").alias("return_rate_pct"), "total_returns"
    )


# --- categories --------------------------------------------------------------


def category_periods(trends: DataFrame) -> DataFrame:
    """Revenue per period label and category; one row per sub-category."""
    label = F.concat(F.col("year").cast("string"), F.lit("-Q"), F.col("quarter").cast("string"))
    return trends.orderBy("year", "quarter").select(
        label.alias("period"), "category", F.round("total_revenue", 0).alias("revenue")
    )


def category_quarters(
    trends: DataFrame, money: int = 2, revenue: str = "total_revenue", profit: str | None = None
) -> DataFrame:
    """As above with year and quarter label apart, optionally with profit."""
    columns = [rounded("total_revenue", money).alias(revenue)]
    if profit:
        columns.append(rounded("total_profit", money).alias(profit))
    return trends.orderBy("year", "quarter", "category").select(
        _year(True),
        F.concat(F.lit("Q"), F.col("quarter").cast("string")).alias("quarter_label"),
        "category",
        *columns,
    )


def category_growth(
    trends: DataFrame,
    keep: Sequence[str],
    money: int | None = 0,
    ratio_digits: int | None = 1,
) -> DataFrame:
    """Quarterly figures with year-over-year growth."""
    columns = {
        "year": "year",
        "quarter": "quarter",
        "category": "category",
        "sub_category": "sub_category",
        "total_revenue": rounded("total_revenue", money),
        "total_profit": rounded("total_profit", money),
        "total_units_sold": "total_units_sold",
        "avg_profit_margin": rounded("avg_profit_margin", ratio_digits),
        "yoy_growth_pct": rounded("yoy_revenue_growth", ratio_digits),
        "yoy_revenue_growth": rounded("yoy_revenue_growth", ratio_digits),
    }
    return _pick(trends.orderBy("year", "quarter", "category"), columns, keep)


def category_summary(trends: DataFrame, money: int = 0, margin_digits: int = 1) -> DataFrame:
    """Totals per category. Orders are summed over groups, so one may count twice."""
    return (
        trends.groupBy("category")
        .agg(
            rounded(F.sum("total_revenue"), money).alias("total_revenue"),
            rounded(F.sum("total_profit"), money).alias("total_profit"),
            F.sum("total_orders").alias("total_orders"),
            rounded(mean("avg_profit_margin"), margin_digits).alias("avg_margin"),
        )
        .orderBy(F.desc_nulls_last("total_revenue"), "category")
    )


def subcategory_margins(trends: DataFrame) -> DataFrame:
    grouped = trends.groupBy("category", "sub_category").agg(
        percent(mean("avg_profit_margin")).alias("avg_margin_pct")
    )
    return grouped.orderBy(F.desc_nulls_last("avg_margin_pct"), "category", "sub_category")


# --- shipping ----------------------------------------------------------------


def shipping(
    modes: DataFrame,
    keep: Sequence[str],
    money: int | None = 0,
    as_percent: bool = True,
) -> DataFrame:
    """Ship modes by revenue."""
    one = 1 if money is not None else None
    columns = {
        "ship_mode": "ship_mode",
        "ship_mode_description": "ship_mode_description",
        "revenue": rounded("total_revenue", money),
        "total_revenue": rounded("total_revenue", money),
        "total_profit": rounded("total_profit", money),
        "total_orders": "total_orders",
        "total_units_shipped": "total_units_shipped",
        "avg_days": rounded("avg_delivery_days", one),
        "avg_delivery_days": rounded("avg_delivery_days", one),
        "margin_pct": _margin(True, 1),
        "avg_profit_margin": _margin(as_percent, one),
        "rev_share": rounded("revenue_share_pct", one),
        "rev_share_pct": rounded("revenue_share_pct", one),
        "revenue_share_pct": rounded("revenue_share_pct", one),
        "order_share_pct": rounded("order_share_pct", one),
    }
    by_revenue = modes.orderBy(F.desc_nulls_last(rounded("total_revenue", money)), "ship_mode")
    return _pick(by_revenue, columns, keep)


def shipping_labels(modes: DataFrame) -> DataFrame:
    """Day and margin labels of the ship mode bars."""
    return modes.select(
        "ship_mode",
        days_label(F.round("avg_delivery_days", 1)).alias("days_label"),
        percent_label(percent("avg_profit_margin")).alias("margin_label"),
    )


# --- SQL text ----------------------------------------------------------------


def run_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """A report given as SQL text over named frames (``{name}`` in the text)."""
    used = {name: df for name, df in tables.items() if "{" + name + "}" in text}
    return spark.sql(text, **used)
