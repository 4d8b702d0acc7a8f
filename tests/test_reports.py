from __future__ import annotations

import pytest
from retail import rows

from shelfmark.plans import reports


def test_ties_of_shown_revenue_are_broken_by_id(spark):
    items = spark.createDataFrame(
        [(i, f"p{i % 10}", "n", 100.0 + i / 100) for i in range(30)],
        "product_key long, product_id string, product_name string, total_revenue double",
    )
    columns = ["category", "sub_category", "total_profit", "total_units_sold", "total_orders",
               "avg_profit_margin", "total_returns", "return_rate", "revenue_rank"]
    items = items.selectExpr("*", *[f"0 AS {c}" for c in columns])
    keep = ("product_name", "revenue", "revenue_rank")
    first = reports.products(items, 5, keep, money=0)
    again = reports.products(items.repartition(7), 5, keep, money=0)
    assert rows(first) == rows(again) and first.count() == 5


def test_worst_returns_keep_only_returned(spark):
    items = spark.createDataFrame(
        [(1, "a", "A", 0, 0.0), (2, "b", "B", 2, 0.125), (3, "c", "C", 1, 2.0)],
        "product_key long, product_id string, product_name string, total_returns int, return_rate double",
    )
    got = [tuple(r) for r in reports.worst_return_rates(items).collect()]
    assert got == [("C", 200.0, 1), ("B", 12.5, 2)]


def test_top_n_is_one_pass(spark):
    items = spark.range(100).selectExpr(
        "id AS customer_key", "id AS customer_id", "'n' AS customer_name", "'s' AS segment", "'t' AS ltv_tier",
        "double(id) AS lifetime_revenue", "double(id) AS lifetime_profit", "id AS total_orders",
        "double(id) AS avg_order_value", "0.5D AS return_rate", "1 AS customer_tenure_days",
    )
    plan = reports.top_customers(items)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_months_by_year(spark):
    monthly = spark.createDataFrame(
        [(2020, 1, 1.0), (2021, 1, 2.0), (2021, 2, 3.0)], "year int, month int, total_revenue double"
    )
    got = reports.monthly_by_year(monthly, [2020, 2021])
    assert rows(got, "month", "2020", "2021") == [(1, 1.0, 2.0), (2, None, 3.0)]
    assert reports.calendar_years(monthly) == [2020, 2021]


def test_kpi_margin_scaling(spark):
    monthly = spark.createDataFrame(
        [(10.0, 5.0, 1, 0.25, 3, 10.0), (20.4, 5.0, 2, 0.75, 4, 10.2)],
        "total_revenue double, total_profit double, total_orders int, avg_profit_margin double, "
        "total_units_sold int, revenue_per_order double",
    )
    assert rows(reports.kpi_totals(monthly)) == [(30.0, 10.0, 3, 50.0)]
    extended = reports.kpi_totals(monthly, margin="avg_margin", as_percent=False, extended=True)
    assert rows(extended) == [(30.0, 10.0, 3, 0.5, 7, 10.0)]


def test_sql_text_over_frames(spark):
    frame = spark.createDataFrame([(1,), (2,)], "x int")
    got = reports.run_sql(spark, "SELECT sum(x) AS s FROM {numbers}", {"numbers": frame, "unused": frame})
    assert rows(got) == [(3,)]


@pytest.mark.parametrize("money", [None, 0])
def test_segments(spark, money):
    customers = spark.createDataFrame(
        [("a", 1.4), ("a", 1.2), ("b", 9.0)], "segment string, lifetime_revenue double"
    )
    got = [tuple(r) for r in reports.segments(customers, money=money).collect()]
    assert got == ([("a", 2), ("b", 1)] if money is None else [("b", 1, 9.0), ("a", 2, 3.0)])
    shares = rows(reports.segment_share(customers), "segment", "share_pct")
    assert shares == [("a", 66.7), ("b", 33.3)]
