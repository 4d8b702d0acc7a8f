from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from retail import orders, returns, rows, star

from shelfmark.operators import stage
from shelfmark.operators.statistics import known_bytes
from shelfmark.plans import dims, facts, pipeline, quality
from shelfmark.plans.schema import RETURN_COLUMNS, SALES_COLUMNS


def at(*args):
    return dt.datetime(*args)


def test_ship_mode_texts(spark):
    modes = ["First Class", "Second Class", "Standard Class", "Same Day", "Drone", None]
    df = dims.dim_ship_mode(orders(spark, *[{"ship_mode": m} for m in modes + modes]))
    text = dict(rows(df, "ship_mode", "ship_mode_description"))
    assert text["Same Day"] == "Same day delivery"
    assert text["First Class"].startswith("Priority") and text["Standard Class"].startswith("Regular")
    assert text["Drone"] == text[None] == "Unknown"
    assert df.count() == 6
    swapped = dims.dim_ship_mode(orders(spark, {"ship_mode": "Drone"}), {"Drone": "By air"}, "?")
    assert rows(swapped, "ship_mode_description") == [("By air",)]


def test_dates_are_a_set_union(spark):
    df = dims.dim_date(
        orders(
            spark,
            {"order_date": at(2021, 1, 1, 23, 59, 59), "ship_date": at(2021, 1, 3)},
            {"order_date": at(2021, 1, 1), "ship_date": None},
            {"order_date": at(2021, 1, 3), "ship_date": at(2024, 1, 6)},
        )
    )
    assert df.columns == [
        "date_key", "date", "year", "quarter", "month", "month_name", "day", "day_of_week",
        "day_name", "week_of_year", "is_weekend",
    ]
    assert rows(df, "date_key", "day_name", "is_weekend") == [
        (20210101, "Friday", False),
        (20210103, "Sunday", True),
        (20240106, "Saturday", True),
        (None, None, False),
    ]


def test_text_dates_are_read_or_null(spark):
    raw = orders(spark, {}).withColumn("order_date", F.lit("2020-02-30")).withColumn(
        "ship_date", F.lit("2020-02-28 10:00:00")
    )
    got = dims.conform_orders(raw).select("order_date", "ship_date", "country", "state").first()
    assert got.order_date is None and got.ship_date == at(2020, 2, 28, 10)


def test_text_dates_by_format_or_an_error(spark):
    from shelfmark.sources import Rejected

    raw = orders(spark, {}, {"order_id": "o2"}).withColumn(
        "order_date", F.when(F.col("order_id") == "o1", "11/8/2016").otherwise("2016-11-09")
    )
    tables = {"orders": raw, "returns": returns(spark, ("No", "o1"))}
    tables["people"] = spark.createDataFrame([("Max", "Central")], "regional_manager string, region string")

    def cached(layer, name, df):
        return df.cache()

    with pytest.raises(Rejected, match="1 x order_date"):
        pipeline.build_star(tables, cached)
    read = pipeline.build_star(tables, cached, date_formats=("M/d/yyyy",))
    assert rows(read["fact_sales"], "order_id", "order_date_key") == [("o1", 20161108), ("o2", 20161109)]
    kept = pipeline.build_star(tables, cached, on_reject="keep")
    assert rows(kept["fact_sales"], "order_id", "order_date_key") == [("o1", None), ("o2", 20161109)]
    assert rows(dims.unread_dates(raw)) == [("order_date", 2, 1), ("ship_date", 2, 0)]


def test_managers_are_not_deduplicated(spark):
    df = star(spark, orders(spark, {}), managers=(("Max", "Central"), ("Max", "Central"), ("Eva", "East")))
    assert df["dim_regional_manager"].count() == 3
    assert df["dim_regional_manager"].columns == ["manager_key", "manager_name", "region"]


@pytest.mark.parametrize("method", ["inline", "join"])
def test_keys_with_versions_fan_out_or_not(spark, method):
    lines = orders(
        spark,
        {"order_id": "o1"},
        {"order_id": "o2", "customer_name": "Anna"},  # same customer id
        {"order_id": "o3", "customer_id": "c2", "product_name": "Stool"},  # same product id
        {"order_id": "o4", "customer_id": "c3", "product_id": "p3", "region": "South"},  # same place
    )
    as_is = star(spark, lines, method=method)["fact_sales"]
    per_order = dict(rows(as_is.groupBy("order_id").count()))
    # customers x products x places the line meets
    assert per_order == {"o1": 8, "o2": 8, "o3": 4, "o4": 2}
    unique = star(spark, lines, method=method, lookup="unique")["fact_sales"]
    assert unique.count() == 4
    assert unique.select("customer_key").distinct().count() == 3
    dims_ = star(spark, lines)
    assert rows(quality.duplicate_keys(dims_)) == [
        ("dim_customer", "c1", 2),
        ("dim_geography", "US|Texas|Austin|73301", 2),
        ("dim_product", "p1", 2),
    ]


@pytest.mark.parametrize("method", ["inline", "join"])
def test_null_postal_code_matches_only_on_request(spark, method):
    lines = orders(spark, {"postal_code": None}, {"order_id": "o2"})
    plain = star(spark, lines, method=method)["fact_sales"]
    assert rows(plain.where("geography_key IS NULL"), "order_id") == [("o1",)]
    safe = star(spark, lines, method=method, null_safe_geography=True)["fact_sales"]
    assert safe.where("geography_key IS NULL").count() == 0 and safe.count() == 2


def test_sales_measures(spark):
    lines = orders(
        spark,
        {"order_id": "a", "sales": 0.0, "profit": -5.0},
        {"order_id": "b", "sales": None, "profit": 1.0},
        {"order_id": "c", "sales": 200.0, "profit": -50.0, "discount": 1.0},
    )
    sales = star(spark, lines)["fact_sales"]
    assert tuple(sales.columns) == SALES_COLUMNS
    assert rows(sales, "order_id", "revenue", "cost", "profit_margin") == [
        ("a", 0.0, 5.0, 0.0),
        ("b", None, None, 0.0),
        ("c", 200.0, 250.0, -0.25),
    ]
    assert rows(sales, "order_date_key", "ship_date_key")[0] == (20200106, 20200108)
    assert sales.select("sales_key").distinct().count() == 3


@pytest.mark.parametrize("method", ["inline", "join"])
def test_returns(spark, method):
    lines = orders(
        spark,
        {"product_id": "p1"},
        {"product_id": "p2"},
        {"product_id": "p3"},
        {"product_id": "p3", "sales": 7.0},  # the same product again
        {"order_id": "o2"},
        {"order_id": "o3"},
        {"order_id": "o4"},
    )
    returned = (("Yes", "o1"), ("No", "o2"), ("yes", "o3"), (None, "o4"), ("Yes", "lost"), ("Yes", None))
    got = star(spark, lines, returned, method=method)
    fact = got["fact_returns"]
    assert tuple(fact.columns) == RETURN_COLUMNS
    per_order = dict(rows(fact.groupBy("order_id").count()))
    assert per_order == {"o1": 3, "lost": 1, None: 1}
    lost = rows(fact.where("order_id = 'lost'"), "order_date_key", "customer_key", "product_key")
    assert lost == [(None, None, None)]
    known = rows(fact.where("order_id = 'o1'").join(got["dim_product"], "product_key"), "product_id")
    assert known == [("p1",), ("p2",), ("p3",)]
    assert fact.select("return_key").distinct().count() == 5


def test_returns_meet_every_version_of_a_customer(spark):
    lines = orders(spark, {}, {"order_id": "o2", "customer_name": "Anna"}, {"customer_name": "Anna"})
    for method in ("inline", "join"):
        fact = star(spark, lines, (("Yes", "o1"),), method=method)["fact_returns"]
        assert fact.count() == 2 and fact.select("customer_key").distinct().count() == 2


@pytest.mark.parametrize("method", ["inline", "join"])
def test_returns_are_looked_up_in_tasks_of_bounded_size(spark, monkeypatch, method):
    lines = [{"order_id": f"o{i % 40}", "product_id": f"p{i % 7}"} for i in range(200)]
    raw = stage(orders(spark, *lines), "orders", measured=True)
    gone = returns(spark, *[("Yes", f"o{i}") for i in range(0, 60, 3)], ("Yes", "o3"), ("Yes", None))
    dimensions = star(spark, raw)
    columns = [c for c in RETURN_COLUMNS if c != "return_key"]
    whole = rows(facts.fact_returns(raw, gone, dimensions, method=method), *columns)
    size = known_bytes(raw)
    monkeypatch.setattr(facts, "SLICE", size // 17 + 1)
    dealt = facts.fact_returns(raw, gone, dimensions, method=method)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(order_id" in plan and ", 17), REPARTITION_BY_NUM" in plan
    assert sorted(map(str, rows(dealt, *columns))) == sorted(map(str, whole)) and len(whole) > 20


def test_repeated_return_counts_twice(spark):
    fact = star(spark, orders(spark, {}), (("Yes", "o1"), ("Yes", "o1")))["fact_returns"]
    assert fact.count() == 2


def test_same_keys_whatever_the_partitions(spark):
    lines = orders(spark, *[{"order_id": f"o{i}", "customer_id": f"c{i % 9}"} for i in range(40)])
    seen = []
    for n in (1, 7, 64):
        sales = star(spark, lines.repartition(n))["fact_sales"]
        seen.append(rows(sales, "order_id", "customer_key", "product_key", "geography_key"))
    assert seen[0] == seen[1] == seen[2]


def test_orphans_and_manager_gaps(spark):
    lines = orders(spark, {}, {"order_id": "o2", "postal_code": None, "region": "East"},
                   {"order_id": "o3", "city": "Dallas", "region": "South"})
    got = star(spark, lines, managers=(("Max", "Central"), ("Eva", "East"), ("Ida", "East")))
    assert rows(quality.manager_fanout(got)) == [("East", 2), ("South", 0)]
    clean = {r[0]: r[2:] for r in rows(quality.orphan_facts(got))}
    assert clean["geography_key"] == (3, 1, 0) and clean["customer_key"] == (3, 0, 0)
    broken = dict(got, dim_product=got["dim_product"].where("false"))
    assert {r[0]: r[2:] for r in rows(quality.orphan_facts(broken))}["product_key"] == (3, 0, 3)


def test_key_clashes_are_found(spark):
    got = star(spark, orders(spark, {}, {"customer_id": "c2"}))
    assert quality.key_clashes(got).isEmpty()
    clashing = dict(got, dim_customer=got["dim_customer"].withColumn("customer_key", F.lit(7)))
    assert rows(quality.key_clashes(clashing)) == [("dim_customer", 7, 2)]


def test_inventory(spark):
    got = star(spark, orders(spark, {}, {"customer_id": "c2"}))
    picked = {"dim_customer": got["dim_customer"], "fact_sales": got["fact_sales"]}
    assert rows(quality.table_inventory({"silver": picked})) == [
        ("silver", "dim_customer", "DIMENSION", 2, 4),
        ("silver", "fact_sales", "FACT", 2, 14),
    ]


def test_fact_is_a_projection_when_keys_are_unique(spark):
    raw = orders(spark, {}, {"order_id": "o2", "customer_id": "c2"})
    lines = dims.conform_orders(raw)
    plan = facts.fact_sales(lines, star(spark, raw))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_returned_orders_join_is_inner(spark):
    lines = dims.conform_orders(orders(spark, {}))
    got = facts.fact_returns(lines, returns(spark, ("Yes", "o1")), star(spark, orders(spark, {})))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    plan = plan.replace("Join LeftOuter, (id#", "")  # of the filter's words, inside a subquery
    assert "LeftOuter" not in plan and "LeftAnti" in plan


def test_folder_of_layers_is_idempotent(spark, tmp_path):
    from shelfmark.sinks import FolderSink

    raw = {"orders": orders(spark, {}, {"order_id": "o2"}), "returns": returns(spark, ("Yes", "o1"))}
    raw["people"] = spark.createDataFrame([("Max", "Central")], "regional_manager string, region string")
    results = []
    for _ in range(2):
        sink = FolderSink(spark, str(tmp_path))
        written = pipeline.build_star(raw, sink)
        pipeline.build_marts(written, sink)
        results.append([(layer, w.table, w.rows, w.columns) for layer, w in sink.log])
    assert results[0] == results[1]
    assert len(results[0]) == 15


@pytest.mark.parametrize("lookup", ["as_is", "unique"])
def test_clashing_keys_are_settled(spark, monkeypatch, tmp_path, lookup):
    """With keys of two bits nearly all rows clash; the facts still find their own rows."""
    from shelfmark.operators import keys
    from shelfmark.sinks import FolderSink

    lines = [
        {"order_id": f"o{i}", "customer_id": f"c{i % 7}", "product_id": f"p{i % 11}", "city": f"t{i % 5}",
         "ship_mode": f"m{i % 9}", "sales": float(i)}
        for i in range(60)
    ]
    raw = {"orders": orders(spark, *lines), "returns": returns(spark, ("Yes", "o3"), ("Yes", "o4"))}
    raw["people"] = spark.createDataFrame([("Max", "Central")], "regional_manager string, region string")

    def shown(star):
        fact = star["fact_sales"]
        for table, key, name in (
            ("dim_customer", "customer_key", "customer_id"),
            ("dim_product", "product_key", "product_id"),
            ("dim_geography", "geography_key", "city"),
            ("dim_ship_mode", "ship_mode_key", "ship_mode"),
        ):
            fact = fact.join(star[table].select(key, name), key, "left")
        back = star["fact_returns"].join(star["dim_product"].select("product_key", "product_id"), "product_key", "left")
        names = ("order_id", "customer_id", "product_id", "city", "ship_mode", "revenue")
        return rows(fact, *names), rows(back, "order_id", "product_id")

    plain = pipeline.build_star(raw, FolderSink(spark, str(tmp_path / "plain")), lookup=lookup)
    expected = shown(plain)
    monkeypatch.setattr(keys, "KEY_BITS", 2)
    forged = pipeline.build_star(raw, FolderSink(spark, str(tmp_path / "forged")), lookup=lookup)
    assert quality.key_clashes(forged).count() == 0
    first = dims.dim_customer(dims.conform_orders(raw["orders"])).select("customer_key").distinct().count()
    assert first <= 4 < forged["dim_customer"].count() == 7
    assert shown(forged) == expected


def test_sizes_are_known_from_the_write(spark, tmp_path):
    from shelfmark.operators.lookup import unpacked_bytes
    from shelfmark.operators.statistics import known_bytes
    from shelfmark.sinks import FolderSink

    sink = FolderSink(spark, str(tmp_path))
    saved = sink("silver", "t", spark.range(50).selectExpr("id", "repeat('x', int(id)) AS s"))
    assert known_bytes(saved) == unpacked_bytes(saved) == 50 * 48 + 49 * 25
    assert known_bytes(saved.select("id").where("id > 3")) == known_bytes(saved)
    assert known_bytes(saved.join(saved.select("id"), "id")) is None
    assert known_bytes(saved.groupBy("id").count()) is None
    assert known_bytes(spark.range(3)) is None
