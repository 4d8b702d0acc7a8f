"""Raw tables over the order schema, from a few rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from retail import rows

from shelfmark.plans.workspace import StagedTables
from shelfmark.sources import raw_orders

DAY = dt.datetime(1996, 3, 4, 13, 30)
TABLES = {
    "region": ("r_regionkey int, r_name string", [(1, "ASIA")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(7, "JAPAN", 1)]),
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        [(c, f"Customer {c}", 7, 0.0, "AUTO") for c in range(20)],
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        [(o, o % 20, "O", 1.0, DAY, "1-URGENT") for o in range(40)] + [(39, 5, "O", 1.0, None, None)],
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        [(p, f"Part {p}", "B", "T", 1, 10.25) for p in range(30)],
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,"
        " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
        [(o, 7 * i + o % 7, 1, i, 3.0, 100.1, 0.05, 0.0, "N", "O", DAY) for o in range(39) for i in range(4)]
        # an order that is there twice; keys that are missing or not found
        + [(39, 1, 1, 0, 2.5, 100.0, -0.0, 0.0, "N", "O", None), (None, None, 1, 0, 1.0, 1.0, 0.0, 0.0, "N", "O", DAY),
           (999, 999, 1, 0, None, None, None, None, None, None, DAY)],
    ),
}


@pytest.fixture
def folder(spark, tmp_path):
    for name, (schema, data) in TABLES.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.fixture
def large(spark):
    """As with tables that are too large to broadcast, in partitions that stay apart."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_of_an_order_end_up_together(spark, folder, large):
    placed = raw_orders(spark, folder).withColumn("_place", F.spark_partition_id())
    spread = placed.groupBy("order_id").agg(F.count_distinct("_place").alias("n"))
    assert rows(spread.select("n").distinct()) == [(1,)]
    assert placed.select("_place").distinct().count() > 1


def test_lines_move_as_cents_and_days(spark, folder, large):
    plan = raw_orders(spark, folder)._jdf.queryExecution().optimizedPlan()
    joins = []
    while not joins or plan.nodeName() in ("Join", "Project"):
        if plan.nodeName() == "Join":
            joins.append({f.name(): f.dataType().simpleString() for f in _attributes(plan.children().apply(0))})
        plan = plan.children().apply(0)
    by_order, by_part = joins  # the outermost join first
    for moved in (by_order, by_part):
        assert moved["l_extendedprice"] == "decimal(12,2)" and moved["l_discount"] == "decimal(4,2)"
        assert moved["l_shipdate"] == "date"
    assert "p_retailprice" in by_order and not any(c.startswith(("o_", "c_")) for c in by_order)


def _attributes(plan):
    out = plan.output()
    return [out.apply(i) for i in range(out.size())]


def test_lines_meet_all_rows_of_their_keys(spark, folder, large):
    got = raw_orders(spark, folder)
    assert got.count() == 39 * 4 + 2 + 2
    columns = ("order_date", "ship_date", "customer_name", "region", "product_name", "sales", "quantity", "discount", "profit")
    day, lost = DAY.date(), (None,) * 3
    usual = rows(got.where("order_id = 7"), *columns)
    assert usual[0] == (day, day, "Customer 7", "ASIA", "Part 0", Decimal("95.0950"), 3, Decimal("0.05"), Decimal("76.6450"))
    assert len(usual) == 4
    # 2.5 pieces: 2 as a count, 3 in the cost
    twice = [(*x, "ASIA", "Part 1", Decimal("100.0000"), 2, Decimal("0.00"), Decimal("81.5500")) for x in ((day, None, "Customer 19"), (None, None, "Customer 5"))]
    assert rows(got.where("order_id = 39"), *columns) == twice
    assert rows(got.where("order_id IS NULL"), *columns) == [(None, day, *lost, Decimal("1.0000"), 1, Decimal("0.00"), None)]
    assert rows(got.where("order_id = 999"), *columns) == [(None, day, *lost, None, None, None, None)]


def test_tables_of_a_workspace_are_staged_in_zstd(spark):
    table = StagedTables({"numbers": lambda: spark.range(3)})["numbers"]
    assert rows(table) == [(0,), (1,), (2,)]
    assert all(f.endswith(".zstd.parquet") for f in table.inputFiles())
