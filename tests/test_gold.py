from __future__ import annotations

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F
from retail import orders, rows, star

from shelfmark.operators.bitmaps import bitmaps, count_bitmaps, count_sketches, new_numbers, sketches
from shelfmark.operators.bloom import might_contain
from shelfmark.plans import marts
from shelfmark.plans.gold import BITMAPS, MARTS, MONTH, PAIRS, SKETCHES, GoldStore, StoredMart, in_years, with_month
from shelfmark.sinks import FolderSink


def _lines(rng, n, months=(1, 2, 3)):
    out = []
    for _ in range(n):
        out.append(
            {
                # an order's lines may lie in several months, and some have no date
                "order_id": f"o{rng.randint(1, 25)}",
                "order_date": rng.choice([dt.datetime(2020, m, rng.randint(1, 28)) for m in months] + [None]),
                "customer_id": f"c{rng.randint(1, 6)}",
                "product_id": f"p{rng.randint(1, 8)}",
                "category": rng.choice(["Furniture", "Office", None]),
                "state/province": rng.choice(["Texas", "Ohio", None]),
                "region": rng.choice(["Central", "East", None]),
                "ship_mode": rng.choice(["First Class", "Same Day"]),
                "sales": float(rng.randint(-50, 400)),
                "quantity": rng.randint(1, 9),
                "discount": rng.choice([0.0, 0.25, 0.5]),
                "profit": float(rng.randint(-20, 20)),
            }
        )
    return out


PLAIN = {
    "agg_monthly_sales": marts.monthly_sales,
    "agg_customer_lifetime_value": marts.customer_lifetime_value,
    "agg_product_performance": marts.product_performance,
    "agg_regional_summary": marts.regional_summary,
    "agg_category_trends": marts.category_trends,
    "agg_shipping_analysis": marts.shipping_analysis,
    "agg_state_performance": marts.state_performance,
}


def _cut(df):
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    managers = (("Max", "Central"), ("Eva", "Central"), ("Max", "East"))
    return star(spark, orders(spark, *_lines(rng, 120)), [("Yes", "o1"), ("Yes", "o4"), ("Yes", "zz")], managers)


@pytest.fixture(scope="module")
def store(spark, tables, tmp_path_factory):
    made = GoldStore(spark, str(tmp_path_factory.mktemp("gold")))
    made.refresh(tables)
    return made


@pytest.mark.parametrize("name", list(PLAIN))
def test_marts_merged_from_state_equal_marts_of_the_fact(tables, store, name):
    assert rows(_cut(store.mart(name, tables))) == rows(_cut(PLAIN[name](tables)))


def test_a_replaced_month_is_the_only_one_read(spark, tables, tmp_path):
    sink = FolderSink(spark, str(tmp_path), {"fact_sales": [MONTH]})
    full = with_month(tables["fact_sales"])
    late = full.where((F.col(MONTH) == 202002) & (F.col("quantity") > 3))
    early = full.where(F.col(MONTH) != 202002).unionByName(late)
    store = GoldStore(spark, str(tmp_path / "gold"))
    store.refresh({**tables, "fact_sales": sink("silver", "fact_sales", early)})
    fact = sink.replace("silver", "fact_sales", full.where(F.col(MONTH) == 202002))
    expected = {name: rows(_cut(plan(tables))) for name, plan in PLAIN.items()}
    others = [f for f in glob.glob(f"{tmp_path}/silver/fact_sales/*/*.parquet") if "=202002/" not in f]
    assert others
    for file in others:  # reading any of them would fail
        with open(file, "wb") as broken:
            broken.write(b"not parquet")
        crc = f"{file.rsplit('/', 1)[0]}/.{file.rsplit('/', 1)[1]}.crc"
        with open(crc, "wb") as broken:
            broken.write(b"")
    now = {**tables, "fact_sales": fact}
    store.refresh(now, [202002])
    for name, want in expected.items():
        assert rows(_cut(store.mart(name, now))) == want


def test_a_year_opens_only_its_months(spark, tables, tmp_path):
    sink = FolderSink(spark, str(tmp_path), {"fact_sales": [MONTH]})
    later = with_month(tables["fact_sales"]).withColumn("order_date_key", F.col("order_date_key") + 10_000)
    fact = with_month(tables["fact_sales"]).unionByName(with_month(later.drop(MONTH)))
    stored = {"fact_sales": sink("silver", "fact_sales", fact), "dim_date": sink("silver", "dim_date", tables["dim_date"])}
    found = in_years(stored, 2020)["fact_sales"]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    plain = tables["fact_sales"].where("order_date_key IS NOT NULL")
    assert rows(found, "order_id", "order_date_key", "revenue") == rows(plain, "order_id", "order_date_key", "revenue")
    for file in glob.glob(f"{tmp_path}/silver/fact_sales/{MONTH}=2021*/*.parquet"):
        with open(file, "wb") as broken:
            broken.write(b"not parquet")
    assert in_years(stored, 2020)["fact_sales"].select("revenue").count() == plain.count()


def test_a_month_that_is_gone_leaves_no_state(spark, tables, tmp_path):
    fact = with_month(tables["fact_sales"])
    store = GoldStore(spark, str(tmp_path))
    store.refresh({**tables, "fact_sales": fact})
    left = {**tables, "fact_sales": fact.where(F.col(MONTH) != 202003)}
    store.refresh(left, [202003])
    assert rows(_cut(store.mart("agg_monthly_sales", left))) == rows(_cut(marts.monthly_sales(left)))


def test_new_values_get_new_numbers_and_old_ones_keep_theirs(spark):
    first = new_numbers(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "value string"), None)
    assert rows(first) == [("a", 1), ("b", 2)]
    more = new_numbers(spark.createDataFrame([("c",), ("a",), ("0",)], "value string"), first)
    assert rows(more) == [("0", 3), ("c", 4)]


@pytest.mark.parametrize("kind", [BITMAPS, PAIRS])
def test_distinct_counts_roll_up_without_counting_twice(spark, tables, tmp_path, kind):
    specs = {"m": StoredMart(marts.categories, marts.category_trends, kind)}
    store = GoldStore(spark, str(tmp_path), specs)
    store.refresh(tables)
    joined = tables["fact_sales"].join(tables["dim_product"].select("product_key", "category"), "product_key", "left")
    exact = joined.groupBy("category").agg(F.count_distinct("order_id").alias("total_orders"))
    found = store.distinct_counts("m", "total_orders", ["category"])
    assert rows(found) == rows(exact)
    summed = store.groups("m", tables).groupBy("category").agg(F.sum("total_orders").alias("total_orders"))
    assert rows(summed) != rows(exact)


def test_bitmaps_cross_the_borders_of_their_buckets(spark):
    numbered = spark.range(1, 100_001).select(F.col("id").alias("number"), (F.col("id") % 3).alias("g"))
    maps = bitmaps(numbered.union(numbered), ["g"])
    assert rows(count_bitmaps(maps, ["g"], "n")) == [(0, 33_333), (1, 33_334), (2, 33_333)]
    assert rows(count_bitmaps(maps, [], "n")) == [(100_000,)]


def test_numbers_follow_the_months_so_their_bitmaps_are_few(spark):
    # months alternate from value to value
    values = spark.range(80_000).select(F.col("id").alias("value"), (F.col("id") % 8).alias("m"))
    numbers = new_numbers(values.union(values.withColumn("m", F.col("m") + 8)), None, ["m"])
    assert rows(numbers.agg(F.min("number"), F.max("number"), F.count_distinct("number"))) == [(1, 80_000, 80_000)]
    maps = bitmaps(values.join(numbers, "value"), ["m"])
    assert rows(count_bitmaps(maps, ["m"], "n")) == [(m, 10_000) for m in range(8)]
    assert maps.count() <= 8 + 2  # 3 buckets, of which a month meets one, or two where it crosses a border


def test_bitmaps_are_made_in_one_place(spark):
    numbered = spark.range(1, 1001).select(F.col("id").alias("number"), (F.col("id") % 3).alias("g"))
    plan = bitmaps(numbered, ["g"])._jdf.queryExecution().executedPlan().toString()
    moved = plan[plan.index("Exchange hashpartitioning"):]
    assert "bitmap_construct_agg" not in moved  # numbers move, no bitmaps of 4 KB


def test_refresh_reads_no_table_that_its_marts_do_not(spark, tables, tmp_path):
    class Lazy(dict):
        def __getitem__(self, name):
            assert name != "fact_returns"
            return super().__getitem__(name)

    store = GoldStore(spark, str(tmp_path), {"agg_monthly_sales": MARTS["agg_monthly_sales"]})
    store.refresh(Lazy(tables))
    found = store.mart("agg_monthly_sales", tables)
    assert rows(_cut(found)) == rows(_cut(marts.monthly_sales(tables)))


def test_sketches_are_within_their_error(spark, tables, tmp_path):
    values = spark.range(60_000).select((F.col("id") % 4).alias("m"), (F.col("id") % 20_000).alias("v"))
    found = sketches(values, ["m"], "v")
    for row in count_sketches(found, ["m"], "n").collect():
        assert abs(row.n - 5_000) < 5_000 * 0.06
    merged = count_sketches(found, [], "n").first().n
    assert abs(merged - 20_000) < 20_000 * 0.06
    store = GoldStore(spark, str(tmp_path), {"m": StoredMart(marts.months, marts.monthly_sales, SKETCHES)})
    store.refresh(tables)
    exact = {r.month: r.total_orders for r in marts.monthly_sales(tables).collect()}
    near = {r.month: r.total_orders for r in store.mart("m", tables).collect()}
    assert near == exact  # few values: sketches are exact


def test_the_filter_lets_through_what_is_there(spark):
    values = spark.range(0, 4_000, 4).select(F.col("id").cast("string").alias("k"))
    values = values.union(spark.createDataFrame([(None,)], "k string"))
    probed = spark.range(4_001).select(F.when(F.col("id") < 4_000, F.col("id").cast("string")).alias("k"))
    found = {r.k for r in probed.where(might_contain(values, "k", F.col("k"), 16)).collect()}
    assert {str(i) for i in range(0, 4_000, 4)} <= found and None not in found
    assert len(found) < 1_200
    assert probed.where(might_contain(values.limit(0), "k", F.col("k"))).count() == 0


def test_returns_take_one_exchange_of_lines(spark, tables, tmp_path):
    """Without broadcasts: lines are dealt by order id once, and orders are read for that alone."""
    import re

    from retail import returns

    from shelfmark.plans import dims, facts

    path = str(tmp_path / "orders")
    orders(spark, *_lines(random.Random(5), 40)).write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        raw = dims.conform_orders(spark.read.parquet(path))
        df = facts.fact_returns(raw, returns(spark, ("Yes", "o1"), ("Yes", "o2"), ("Yes", "no")), tables)
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    scans = re.findall(r"(?<!ReusedExchange )FileScan parquet \[order_id", text)
    assert len(re.findall(r"FileScan parquet", text)) <= 2 and scans
    assert "SinglePartition" not in text.split("Subquery")[0]


def test_repeated_returns_and_lost_ones(spark):
    lines = [{"order_id": "o1", "product_id": "p1"}, {"order_id": "o1", "product_id": "p2"}, {"order_id": "o2"}]
    found = star(spark, orders(spark, *lines, lines[0]), [("Yes", "o1"), ("Yes", "o1"), ("Yes", "x"), ("Yes", "x"), ("No", "o2")])
    got = rows(found["fact_returns"], "order_id", "product_key")
    assert [g[0] for g in got].count("o1") == 4 and [g for g in got if g[0] == "x"] == [("x", None)] * 2
    assert len(got) == 6 and set(MARTS) == set(PLAIN)
