from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from retail import orders, rows, star

from shelfmark.plans import marts


def on(year, month, day=5):
    return {"order_date": dt.datetime(year, month, day), "ship_date": dt.datetime(year, month, day + 2)}


def line(order, sales, **more):
    return {"order_id": order, "sales": sales, "profit": sales / 4 if sales is not None else None, **more}


def one(df, **where):
    for column, value in where.items():
        df = df.where(F.col(column).eqNullSafe(F.lit(value)))
    found = df.collect()
    assert len(found) == 1, found
    return found[0]


def test_monthly_means_are_unweighted(spark):
    t = star(
        spark,
        orders(
            spark,
            line("a", 1000.0, **on(2020, 1), discount=0.5),
            {**line("a", 10.0, **on(2020, 1)), "profit": 10.0},
            line("b", 10.0, **on(2020, 2)),
        ),
    )
    row = one(marts.monthly_sales(t), year=2020, month=1)
    assert row.total_orders == 1 and row.total_units_sold == 4
    assert row.avg_profit_margin == (0.25 + 1.0) / 2  # not profit / revenue
    assert row.total_discount_amount == 500.0
    assert row.revenue_per_order == 1010.0 and row.avg_line_item_value == 505.0
    assert row.month_name == "January"


def test_line_without_date_is_a_null_month(spark):
    t = star(spark, orders(spark, line("a", 5.0, order_date=None), line("b", 1.0)))
    row = one(marts.monthly_sales(t), year=None)
    assert (row.month, row.total_revenue, row.total_orders) == (None, 5.0, 1)


def test_customer_value(spark):
    lines = orders(
        spark,
        line("a", 3000.0, **on(2020, 1)),
        line("a", 1000.0, **on(2020, 1), product_id="p2"),
        line("b", 1000.0, **on(2021, 3)),
        line("c", 499.99, customer_id="c2"),
    )
    t = star(spark, lines, (("Yes", "a"), ("Yes", "a"), ("Yes", "lost")))
    row = one(marts.customer_lifetime_value(t), customer_id="c1")
    assert row.total_returns == 1  # orders, however many return rows
    assert row.return_rate == 0.5 and row.ltv_tier == "Platinum"
    assert row.avg_order_value == pytest.approx(5000 / 3)  # mean line revenue
    assert row.customer_tenure_days == (dt.date(2021, 3, 5) - dt.date(2020, 1, 5)).days
    other = one(marts.customer_lifetime_value(t), customer_id="c2")
    assert (other.total_returns, other.return_rate, other.ltv_tier) == (0, 0.0, "Bronze")
    raised = marts.customer_lifetime_value(t, tiers=(("Top", 9000), ("Mid", 5000)), lowest="Low")
    assert one(raised, customer_id="c1").ltv_tier == "Mid"


def test_unknown_customer_is_one_group_without_returns(spark):
    lines = orders(spark, line("a", 10.0, customer_id=None), line("b", 20.0, customer_id=None))
    t = star(spark, lines, (("Yes", "lost"), ("Yes", "a")))
    row = one(marts.customer_lifetime_value(t), customer_key=None)
    assert (row.customer_id, row.lifetime_revenue, row.total_orders) == (None, 30.0, 2)
    assert row.total_returns == 0


def test_product_ranks_and_returns(spark):
    lines = orders(
        spark,
        line("a", 50.0, product_id="p1"),
        line("b", 50.0, product_id="p2"),
        line("c", 20.0, product_id="p3"),
        line("c", 90.0, product_id="p4"),
        line("d", None, product_id="p5"),
    )
    t = star(spark, lines, (("Yes", "a"), ("Yes", "a"), ("Yes", "c")))
    got = marts.product_performance(t, slices=3)
    ranks = dict((r[0], r[1:]) for r in rows(got, "product_id", "revenue_rank", "total_returns", "return_rate"))
    assert ranks == {
        "p1": (2, 2, 2.0),  # return rows, so two for one order
        "p2": (2, 0, 0.0),
        "p3": (4, 1, 1.0),
        "p4": (1, 1, 1.0),  # every line of a returned order
        "p5": (5, 0, 0.0),  # NULL total last
    }


@pytest.mark.parametrize("limit", [0, 100_000])
def test_regions_with_none_one_and_two_managers(spark, limit):
    lines = orders(
        spark,
        line("a", 10.0),
        line("b", 20.0, city="Boston", region="East"),
        line("b", 30.0, city="Boston", region="East", customer_id="c2"),
        line("c", 40.0, city="Reno", region="West"),
        line("d", 5.0, postal_code=None),
    )
    t = star(spark, lines, managers=(("Max", "Central"), ("Eva", "East"), ("Ida", "East")))
    got = marts.regional_summary(t, max_broadcast_bytes=limit)
    assert rows(got, "region", "manager_name", "total_revenue", "total_orders", "total_customers") == [
        ("Central", "Max", 10.0, 1, 1),
        ("East", "Eva", 50.0, 1, 2),
        ("East", "Ida", 50.0, 1, 2),
        ("West", None, 40.0, 1, 1),
        (None, None, 5.0, 1, 1),
    ]
    assert one(got, manager_name="Eva").revenue_per_customer == 25.0


@pytest.mark.parametrize("limit", [0, 100_000])
def test_category_growth_over_a_gap(spark, limit):
    lines = orders(
        spark,
        line("a", 100.0, **on(2020, 2)),
        line("b", 150.0, **on(2021, 1)),
        line("b", 50.0, **on(2021, 1), category="Technology", product_id="p2"),
        {**line("c", 300.0, **on(2023, 3)), "profit": -10.0},
    )
    t = star(spark, lines)
    got = marts.category_trends(t, max_broadcast_bytes=limit)
    chairs = got.where("category = 'Furniture'")
    assert rows(chairs, "year", "prev_year_revenue", "yoy_revenue_growth") == [
        (2020, None, None),
        (2021, 100.0, 50.0),
        (2023, 150.0, 100.0),
    ]
    assert one(chairs, year=2023).yoy_profit_growth == pytest.approx((-10 - 37.5) / 37.5 * 100)
    strict = marts.category_trends(t, strict_year=True).where("category = 'Furniture'")
    assert rows(strict, "year", "prev_year_revenue") == [(2020, None), (2021, 100.0), (2023, None)]
    # the order counts in both categories it spans
    assert got.where("year = 2021").agg(F.sum("total_orders")).first()[0] == 2


def test_shipping_days_and_shares(spark):
    lines = orders(
        spark,
        line("a", 60.0, ship_date=dt.datetime(2020, 1, 3)),  # shipped before it was ordered
        line("a", 20.0, ship_mode="Same Day"),
        line("b", 20.0, ship_mode="Same Day"),
    )
    got = marts.shipping_analysis(star(spark, lines))
    first = one(got, ship_mode="First Class")
    assert (first.min_delivery_days, first.avg_delivery_days) == (-3, -3.0)
    assert first.revenue_share_pct == 60.0
    # order a counts for both modes, so the base is 3
    assert first.order_share_pct == pytest.approx(100 / 3)
    assert got.agg(F.sum("order_share_pct")).first()[0] == pytest.approx(100)


@pytest.mark.parametrize("limit", [0, 100_000])
def test_states(spark, limit):
    texas, ohio = {"state/province": "Texas"}, {"state/province": "Ohio", "city": "Akron"}
    lines = orders(
        spark,
        line("a", 80.0, **texas, **on(2020, 1)),
        line("a", 20.0, **texas, **on(2020, 1), product_id="p2"),
        line("b", 60.0, **texas, **on(2020, 4), customer_id="c2"),
        {**line("c", 160.0, **ohio, **on(2020, 2)), "profit": 160.0},
    )
    got = marts.state_performance(star(spark, lines), max_broadcast_bytes=limit)
    row = one(got, state="Texas")
    assert (row.total_orders, row.total_customers, row.orders_per_customer) == (2, 2, 1.0)
    assert row.avg_order_value == 80.0 and row.profit_to_cost_ratio == pytest.approx(40 / 120)
    assert (row.first_order_date, row.last_order_date) == (dt.date(2020, 1, 5), dt.date(2020, 4, 5))
    assert one(got, state="Ohio").profit_to_cost_ratio == 0.0  # no cost
    assert rows(got, "state_revenue_rank") == [(1,), (1,)]


def test_totals_agree_across_marts(spark):
    lines = orders(
        spark,
        *[
            line(f"o{i % 17}", float(i), **on(2019 + i % 3, 1 + i % 12), customer_id=f"c{i % 5}",
                 product_id=f"p{i % 7}", category=f"k{i % 2}", ship_mode=["Same Day", "Drone"][i % 2],
                 postal_code=None if i % 9 == 0 else "1")
            for i in range(60)
        ],
    )
    # product ids stay with one category each
    lines = lines.withColumn("category", F.concat(F.lit("k"), F.substring("product_id", 2, 1)))
    t = star(spark, lines)
    expected = float(sum(range(60)))
    for mart, column in (
        (marts.monthly_sales, "total_revenue"),
        (marts.customer_lifetime_value, "lifetime_revenue"),
        (marts.product_performance, "total_revenue"),
        (marts.regional_summary, "total_revenue"),
        (marts.category_trends, "total_revenue"),
        (marts.shipping_analysis, "total_revenue"),
        (marts.state_performance, "total_revenue"),
    ):
        assert mart(t).agg(F.sum(column)).first()[0] == expected, mart.__name__
