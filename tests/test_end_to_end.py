"""A workbook folder, through raw tables and star schema, to marts and SQL."""

from __future__ import annotations

import datetime as dt

import workbooks
from retail import rows

from shelfmark.plans.pipeline import build_marts, build_star, ingest_folder
from shelfmark.sinks import TableSink

HEADER = [
    "Row ID", "Order ID", "Order Date", "Ship Date", "Ship Mode", "Customer ID", "Customer Name",
    "Segment", "Country/Region", "City", "State/Province", "Postal Code", "Region", "Product ID",
    "Category", "Sub-Category", "Product Name", "Sales", "Quantity", "Discount", "Profit",
]


def _line(row, order, customer, product, sales):
    return [
        row, order, dt.datetime(2020, 1, 6), dt.datetime(2020, 1, 9), "Same Day", customer,
        f"Name {customer}", "Consumer", "US", "Austin", "Texas", 73301, "Central", product,
        "Furniture", "Chairs", f"Chair {product}", sales, 2, 0.1, sales / 4,
    ]


def test_workbook_to_marts(spark, tmp_path):
    workbooks.write(
        tmp_path / "Retail.xlsx",
        {
            "Orders": [HEADER, _line(1, "o1", "c1", "p1", 100.5), _line(2, "o1", "c1", "p2", 50.0),
                       _line(3, "o2", "c2", "p1", 10.0)],
            "People": [["Regional Manager", "Region"], ["Max", "Central"]],
            "Returns": [["Returned", "Order ID"], ["Yes", "o1"]],
        },
    )
    layers = ("staging", "bronze", "silver", "gold")
    sink = TableSink(spark, {layer: f"e2e_{layer}" for layer in layers})
    raw, _ = ingest_folder(spark, str(tmp_path), sink)
    build_marts(build_star(raw, sink), sink)

    customers = spark.sql(
        "SELECT customer_id, lifetime_revenue, total_returns, ltv_tier "
        "FROM e2e_gold.agg_customer_lifetime_value"
    )
    assert rows(customers) == [("c1", 150.5, 1, "Bronze"), ("c2", 10.0, 0, "Bronze")]
    regions = spark.table("e2e_gold.agg_regional_summary")
    assert rows(regions, "region", "manager_name", "total_revenue", "total_orders") == [
        ("Central", "Max", 160.5, 2)
    ]
    modes = spark.table("e2e_gold.agg_shipping_analysis")
    assert rows(modes, "avg_delivery_days", "revenue_share_pct") == [(3.0, 100.0)]
    assert {w.table.split(".")[0] for _, w in sink.log} == {f"e2e_{layer}" for layer in layers}
