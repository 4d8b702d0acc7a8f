"""Small raw tables built by hand."""

from __future__ import annotations

import datetime as dt

from shelfmark.plans import pipeline

ORDER_SCHEMA = """order_id string, order_date timestamp, ship_date timestamp, ship_mode string,
customer_id string, customer_name string, segment string, `country/region` string, city string,
`state/province` string, postal_code string, region string, product_id string, category string,
sub_category string, product_name string, sales double, quantity int, discount double,
profit double"""

LINE = {
    "order_id": "o1",
    "order_date": dt.datetime(2020, 1, 6),
    "ship_date": dt.datetime(2020, 1, 8),
    "ship_mode": "First Class",
    "customer_id": "c1",
    "customer_name": "Ann",
    "segment": "Consumer",
    "country/region": "US",
    "city": "Austin",
    "state/province": "Texas",
    "postal_code": "73301",
    "region": "Central",
    "product_id": "p1",
    "category": "Furniture",
    "sub_category": "Chairs",
    "product_name": "Chair",
    "sales": 100.0,
    "quantity": 2,
    "discount": 0.0,
    "profit": 25.0,
}


def orders(spark, *changes: dict):
    """One order line per dict of differences to LINE."""
    rows = [tuple({**LINE, **change}.values()) for change in changes]
    return spark.createDataFrame(rows, ORDER_SCHEMA)


def returns(spark, *rows: tuple):
    return spark.createDataFrame(list(rows), "returned string, order_id string")


def people(spark, *rows: tuple):
    return spark.createDataFrame(list(rows), "regional_manager string, region string")


def star(spark, lines, returned=(), managers=(("Max", "Central"),), **options):
    """Star schema of raw tables, cached instead of written."""
    raw = {
        "orders": lines,
        "returns": returns(spark, *returned),
        "people": people(spark, *managers),
    }
    return pipeline.build_star(raw, lambda layer, name, df: df.cache(), **options)


def rows(df, *columns):
    """Rows as tuples in a fixed order."""
    found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))
