from __future__ import annotations

import pytest
from retail import rows

from shelfmark.plans.widgets import Field, Widget


@pytest.fixture(scope="module")
def datasets(spark):
    return {"sales": spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "shop string, units int")}


def test_figures_of_all_rows(datasets):
    widget = Widget("sales", [Field("n", "count(*)"), Field("units", "sum(units) * 2")])
    assert rows(widget.frame(datasets)) == [(3, 6)]


def test_fields_that_do_not_aggregate_group_the_others(datasets):
    widget = Widget("sales", [Field("units", "sum(units)"), Field("name", "upper(shop)"), Field("n", "count(units)")])
    frame = widget.frame(datasets)
    assert frame.columns == ["units", "name", "n"]
    assert rows(frame, "name", "units", "n") == [("A", 3, 2), ("B", None, 0)]


def test_rows_kept_apart_or_not(datasets):
    fields = [Field("shop", "shop")]
    assert rows(Widget("sales", fields, disaggregated=True).frame(datasets)) == [("a",), ("a",), ("b",)]
    assert rows(Widget("sales", fields).frame(datasets)) == [("a",), ("b",)]


@pytest.mark.parametrize(
    "widget",
    [
        Widget("none", [Field("n", "count(*)")]),
        Widget("sales", []),
        Widget("sales", [Field("n", "count(*)"), Field("n", "1")]),
        Widget("sales", [Field("n", "count(*)")], disaggregated=True),
    ],
)
def test_declarations_that_do_not_hold_together(datasets, widget):
    with pytest.raises(ValueError):
        widget.frame(datasets)
