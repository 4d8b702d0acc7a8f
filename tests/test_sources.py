from __future__ import annotations

import datetime as dt

import pytest
import workbooks
from pyspark.sql import functions as F
from pyspark.sql import types as T
from retail import rows
from workbooks import Styled

from shelfmark.plans.pipeline import ingest_folder
from shelfmark.sinks import FolderSink, TableSink, materialize, replace_partitions
from shelfmark.sources import Rejected, discover, read_csv, read_workbooks, sheet_table, sheets


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    workbooks.write(
        source / "Retail Data.xlsx",
        {
            "Orders (2020)": [
                ["Row ID", "Order Date", "Sub-Category", "Sales", None, "Flag", "Sales"],
                [1, dt.datetime(2020, 1, 6), "Chairs", 10.5, "x", True, 1],
                [2, dt.datetime(2020, 1, 7, 12), "Tables & more", 3, None, False, "#DIV/0!"],
                [None, None, None, None, None, None, None],
                [3, None, "inline:Bins", -2, "y", None, 2.5],
            ],
            "Empty": [["a", "b"]],
            "Blank": [],
        },
    )
    (source / "Store-List.csv").write_text("Store ID,Opened\n7,2020-01-01\n8,\n")
    (source / "LOUD.CSV").write_text("a,b\n1,x\n")
    (source / "header_only.csv").write_text("a,b\n")
    (source / "notes.txt").write_text("hello")
    (source / "old.xls").write_bytes(b"\xd0\xcf")
    (source / "sub").mkdir()
    (source / "sub" / "deep.csv").write_text("a\n1\n")
    return source


def test_discover_lists_without_reading(spark, folder):
    found = discover(spark, str(folder))
    assert rows(found, "file", "stem", "kind") == [
        ("LOUD.CSV", "LOUD", "csv"),
        ("Retail Data.xlsx", "Retail Data", "workbook"),
        ("Store-List.csv", "Store-List", "csv"),
        ("header_only.csv", "header_only", "csv"),
        ("notes.txt", "notes", "unsupported"),
        ("old.xls", "old", "legacy_workbook"),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_sheet_types_names_and_blank_rows(spark, folder):
    cells = read_workbooks(spark, [str(folder / "Retail Data.xlsx")])
    (sheet,) = sheets(cells).collect()
    assert sheet.sheet == "Orders (2020)" and sheet.rows == 3
    table = sheet_table(cells, sheet.file, sheet.sheet, sheet.columns)
    assert table.dtypes == [
        ("row_id", "bigint"),
        ("order_date", "timestamp"),
        ("sub_category", "string"),
        ("sales", "double"),
        ("unnamed:_4", "string"),
        ("flag", "boolean"),
        ("sales.1", "double"),
    ]
    assert rows(table) == [
        (1, dt.datetime(2020, 1, 6), "Chairs", 10.5, "x", True, 1.0),
        (2, dt.datetime(2020, 1, 7, 12), "Tables & more", 3.0, None, False, None),
        (3, None, "Bins", -2.0, "y", None, 2.5),
    ]


def test_given_schema_wins_and_bad_cells_are_null(spark, folder):
    cells = read_workbooks(spark, [str(folder / "Retail Data.xlsx")])
    (sheet,) = sheets(cells).collect()
    schema = T.StructType([T.StructField("sub_category", T.IntegerType()), T.StructField("row_id", T.StringType())])
    table = sheet_table(cells, sheet.file, sheet.sheet, sheet.columns, schema)
    assert rows(table, "row_id", "sub_category") == [("1", None), ("2", None), ("3", None)]


def test_date_styles(spark, tmp_path):
    workbooks.write(tmp_path / "d.xlsx", {"d": [["builtin", "custom", "quoted"],
                                               [Styled(43831, 1), Styled(43831.5, 2), Styled(4.5, 3)]]})
    cells = read_workbooks(spark, [str(tmp_path / "d.xlsx")])
    (sheet,) = sheets(cells).collect()
    assert rows(sheet_table(cells, sheet.file, sheet.sheet, sheet.columns)) == [
        (dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1, 12), 4.5)
    ]


def test_colliding_headers_are_an_error(spark, tmp_path):
    workbooks.write(tmp_path / "c.xlsx", {"c": [["Order ID", "order-id"], [1, 2]]})
    cells = read_workbooks(spark, [str(tmp_path / "c.xlsx")])
    (sheet,) = sheets(cells).collect()
    with pytest.raises(ValueError, match="order_id"):
        sheet_table(cells, sheet.file, sheet.sheet, sheet.columns)


def test_csv_names_and_schema(spark, folder):
    path = str(folder / "Store-List.csv")
    assert read_csv(spark, path).dtypes == [("store_id", "int"), ("opened", "date")]
    assert read_csv(spark, path, clean=False).columns == ["Store ID", "Opened"]
    typed = read_csv(spark, path, schema="store_id string, opened string")
    assert rows(typed) == [("7", "2020-01-01"), ("8", None)]


def test_folder_becomes_tables(spark, folder):
    sink = TableSink(spark, {"bronze": "t_bronze", "staging": "t_staging"})
    tables, report = ingest_folder(spark, str(folder), sink)
    assert sorted(tables) == ["loud", "orders_2020", "store_list"]
    assert rows(spark.table("t_bronze.orders_2020"), "row_id") == [(1,), (2,), (3,)]
    status = sorted((r.source.rsplit("/", 1)[1], r.status) for r in report)
    assert status == [
        ("LOUD.CSV", "written"),
        ("Retail Data.xlsx#Empty", "empty"),
        ("Retail Data.xlsx#Orders (2020)", "written"),
        ("Store-List.csv", "written"),
        ("header_only.csv", "empty"),
        ("notes.txt", "unsupported"),
        ("old.xls", "unsupported"),
    ]
    counts = {w.table: w.rows for _, w in sink.log}
    assert counts["t_bronze.store_list"] == 2


def test_colliding_tables_are_an_error_before_any_write(spark, folder, tmp_path):
    (folder / "store list.csv").write_text("a\n1\n")
    sink = FolderSink(spark, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="store_list"):
        ingest_folder(spark, str(folder), sink)
    assert [w.table for layer, w in sink.log if layer == "bronze"] == []


def test_materialize_runs_the_plan_once(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS t_sink")
    runs = spark.sparkContext.accumulator(0)

    def touch(batches):
        for batch in batches:
            runs.add(len(batch))
            yield batch

    df = spark.range(50).mapInPandas(touch, "id long")
    for _ in range(2):  # overwriting gives the same table
        saved, written = materialize(df, "t_sink.once")
        assert (written.rows, written.columns, saved.count()) == (50, 1, 50)
    assert runs.value == 100


def test_partitions_are_replaced(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS t_sink")
    first = spark.createDataFrame([(1, 2020), (2, 2020), (3, 2021)], "x int, y int")
    saved, _ = materialize(first, "t_sink.parts", partition_by=["y"])
    assert saved.count() == 3
    again = spark.createDataFrame([(2021, 9)], "y int, x int")
    assert replace_partitions(again, "t_sink.parts").rows == 1
    assert rows(spark.table("t_sink.parts"), "x", "y") == [(1, 2020), (2, 2020), (9, 2021)]
    plan = spark.table("t_sink.parts").where("y = 2021")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(y" in plan


def test_one_task_a_sheet_and_one_partition_a_table(spark, tmp_path):
    path = tmp_path / "Many.xlsx"
    book = {f"S {i}": [["a", "b"], *[[i, f"text {i}.{k}"] for k in range(i + 1)]] for i in range(5)}
    workbooks.write(path, book)
    cells = read_workbooks(spark, [str(path)])
    assert cells.rdd.getNumPartitions() == 5
    by_task = cells.groupBy(F.spark_partition_id()).agg(F.count_distinct("sheet").alias("n")).collect()
    assert [r.n for r in by_task] == [1] * 5
    sink = FolderSink(spark, str(tmp_path / "out"))
    stored = sink("staging", "workbook_rows", cells)
    for sheet in sheets(stored).collect():
        table = sheet_table(stored, sheet.file, sheet.sheet, sheet.columns)
        i = int(sheet.sheet[2:])
        assert rows(table) == sorted((i, f"text {i}.{k}") for k in range(i + 1))
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "isnotnull(sheet" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_dates_by_format_and_rejects(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "orders.csv").write_text("id,order_date,ship_date\n1,11/8/2016,2016-11-11\n2,,12.11.2016\n3,8/31/2017,\n")
    formats = {"orders": {"order_date": ("M/d/yyyy",), "ship_date": ("d.M.yyyy",)}}
    tables, report = ingest_folder(spark, str(source), FolderSink(spark, str(tmp_path / "a")), dates=formats)
    got = tables["orders"].select("id", F.date_format("order_date", "yyyyMMdd"), F.date_format("ship_date", "yyyyMMdd"))
    assert rows(got) == [(1, "20161108", "20161111"), (2, None, "20161112"), (3, "20170831", None)]
    assert report[0].rejected == {}
    unread = {"orders": {"order_date": (), "ship_date": ("d.M.yyyy",)}}
    with pytest.raises(Rejected, match="2 x order_date"):
        ingest_folder(spark, str(source), FolderSink(spark, str(tmp_path / "b")), dates=unread)
    tables, report = ingest_folder(
        spark, str(source), FolderSink(spark, str(tmp_path / "c")), dates=unread, on_reject="keep"
    )
    assert report[0].rejected == {"order_date": 2} and tables["orders"].where("order_date IS NULL").count() == 3
    with pytest.raises(ValueError, match="no such date columns"):
        ingest_folder(spark, str(source), FolderSink(spark, str(tmp_path / "d")), dates={"orders": {"day": ()}})


def test_rows_that_do_not_fit_a_schema(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "t.csv").write_text("Store ID,Opened\n7,2020-01-01\nseven,2020-01-02\n8,2020-01-03,extra\n9,\n")
    schema = {"t": T.StructType.fromDDL("store_id int, opened date")}
    with pytest.raises(Rejected, match="2 x row"):
        ingest_folder(spark, str(source), FolderSink(spark, str(tmp_path / "a")), schema)
    tables, report = ingest_folder(
        spark, str(source), FolderSink(spark, str(tmp_path / "b")), schema, on_reject="keep"
    )
    assert report[0].rejected == {"row": 2}
    assert tables["t"].columns == ["store_id", "opened"] and tables["t"].count() == 4
