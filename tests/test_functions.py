from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfmark import functions as fn


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("Sub-Category", "sub_category"),
        (" Country/Region ", "country/region"),
        ("Sales (USD)", "sales_usd"),
        ("\tOrder ID\n", "order_id"),
        ("A--B  C", "a__b__c"),
        ("()", ""),
    ],
)
def test_clean_name_and_expression_agree(spark, raw, clean):
    assert fn.clean_name(raw) == clean
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(fn.clean_expr("s")).first()[0] == clean


def test_clean_columns_renames_and_rejects_collisions(spark):
    df = spark.createDataFrame([(1, 2)], "`Order ID` int, `Sub-Category` int")
    assert fn.clean_columns(df).columns == ["order_id", "sub_category"]
    clash = spark.createDataFrame([(1, 2)], "`Order ID` int, `order-id` int")
    with pytest.raises(ValueError, match="order_id"):
        fn.clean_columns(clash)


def test_table_kind(spark):
    df = spark.createDataFrame([("dim_a",), ("fact_b",), ("agg_c",)], "t string")
    assert [r[0] for r in df.select(fn.table_kind("t")).collect()] == ["DIMENSION", "FACT", "FACT"]


@pytest.mark.parametrize(
    ("day", "key", "dow", "week", "weekend"),
    [
        (dt.date(2024, 1, 7), 20240107, 1, 1, True),  # a Sunday
        (dt.date(2024, 1, 6), 20240106, 7, 1, True),
        (dt.date(2021, 1, 1), 20210101, 6, 53, False),  # ISO week of the year before
        (dt.date(9, 12, 31), 91231, 5, 53, False),
    ],
)
def test_calendar(spark, day, key, dow, week, weekend):
    df = spark.createDataFrame([(day,)], "date date")
    named = fn.calendar_columns("date")
    row = df.select(*[c.alias(n) for n, c in named.items()]).first()
    assert (row.date_key, row.day_of_week, row.week_of_year, row.is_weekend) == (key, dow, week, weekend)
    assert row.year == day.year and row.quarter == (day.month + 2) // 3


def test_date_key_equals_formatted_date(spark):
    df = spark.sql("SELECT explode(sequence(date'1999-12-01', date'2004-03-05')) AS d")
    text = F.date_format("d", "yyyyMMdd").cast("int")
    assert df.where(fn.date_key("d") != text).count() == 0


def test_ratios(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, -2.0), (1.0, 4.0)], "a double, b double")
    got = df.select(fn.ratio("a", "b"), fn.guarded_ratio("a", "b")).collect()
    assert [tuple(r) for r in got] == [(None, 0.0), (None, 0.0), (-1.5, 0.0), (0.25, 0.25)]


def test_growth(spark):
    df = spark.createDataFrame(
        [(150.0, 100.0), (50.0, None), (50.0, 0.0), (10.0, -20.0)], "c double, p double"
    )
    assert [r[0] for r in df.select(fn.growth_pct("c", "p")).collect()] == [50.0, None, None, -150.0]


def test_mean_is_exact_for_decimals_and_skips_null(spark):
    df = spark.sql("SELECT * FROM VALUES (1.10BD), (2.20BD), (NULL) t(x)")
    assert df.agg(fn.mean("x")).first()[0] == 1.65
    assert df.where("x > 9").agg(fn.mean("x")).first()[0] is None


def test_band_edges(spark):
    values = [4999.99, 5000.0, 2000.0, 1999.99, 500.0, 499.99, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    floors = (("Platinum", 5000), ("Gold", 2000), ("Silver", 500))
    got = [r[0] for r in df.select(fn.band("x", floors, "Bronze")).collect()]
    assert got == ["Gold", "Platinum", "Gold", "Silver", "Silver", "Bronze", "Bronze"]
    with pytest.raises(ValueError, match="high to low"):
        fn.band("x", floors[::-1], "Bronze")


def test_labels(spark):
    df = spark.createDataFrame([(1234567.0, 12.34)], "m double, p double")
    row = df.select(fn.money_label("m"), fn.percent_label("p"), fn.days_label("p")).first()
    assert tuple(row) == ("$1,234,567", "12.3%", "12.3d")


def test_percent_rounds_half_up(spark):
    df = spark.createDataFrame([(0.0625,), (0.333,)], "x double")
    assert [r[0] for r in df.select(fn.percent("x")).collect()] == [6.3, 33.3]
