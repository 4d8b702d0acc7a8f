"""Multi-sheet ``.xlsx`` source.

Workbooks are read by the executors, one row of cells at a time, and never pass
through the driver. A row keeps its cells as an array in sheet order, so a
sheet becomes a table by projection, without a pivot or a shuffle.
"""

from __future__ import annotations

import io
import itertools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.naming import clean_name, require_distinct
from shelfmark.operators.staging import stage
from shelfmark.sources.xlsx import packages_of_sheets, sheet_rows

ROWS_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("row_no", T.LongType()),
        T.StructField("kinds", T.ArrayType(T.StringType())),
        T.StructField("cells", T.ArrayType(T.StringType())),
    ]
)
_PACKED = "file string, sheet string, package binary"
_CHUNK = 2_000
WORKBOOK_ROWS = "workbook_rows"  # the table of rows, partitioned by file and sheet where a sink can

# Cell kinds from narrow to wide, and the column type they ask for.
_TYPE_OF_KINDS = {
    ("bool",): "boolean",
    ("int",): "bigint",
    ("float",): "double",
    ("float", "int"): "double",
    ("date",): "timestamp",
}


def read_workbooks(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows (file, sheet, row_no, kinds, cells) of all sheets of the workbooks.

    Row 0 of a sheet is its header. First the packages are taken apart: one row
    per sheet, with its part of the package still compressed, and what all
    sheets need (strings and styles). These rows are written, then dealt one to
    a task, which unpacks its sheet alone and holds a chunk of rows.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    packed = stage(files.mapInPandas(_take_apart, _PACKED), "sheets")
    n = packed.count()  # one row per sheet
    return packed.repartition(max(n, 1)).mapInPandas(_parse, ROWS_SCHEMA)


def _take_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            for sheet, package in packages_of_sheets(content):
                yield pd.DataFrame([(path, sheet, package)], columns=["file", "sheet", "package"])


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, package in zip(batch["file"], batch["package"], strict=True):
            rows = ((path, *row) for row in sheet_rows(io.BytesIO(package)))
            while chunk := list(itertools.islice(rows, _CHUNK)):
                yield pd.DataFrame(chunk, columns=ROWS_SCHEMA.names)


def sheets(rows: DataFrame) -> DataFrame:
    """One row per sheet with data: header and the kinds seen per column.

    Aggregated where the rows are; the result is one small row per sheet.
    """
    position = rows.select(
        "file", "sheet", "row_no", F.posexplode_outer("kinds").alias("col_no", "kind"), "cells"
    )
    columns = position.groupBy("file", "sheet", "col_no").agg(
        F.max(F.when(F.col("row_no") == 0, F.col("cells")[F.col("col_no")])).alias("title"),
        F.sort_array(F.collect_set(F.when(F.col("row_no") > 0, F.col("kind")))).alias("kinds"),
        F.max("row_no").alias("last_row"),
    )
    return (
        columns.groupBy("file", "sheet")
        .agg(
            F.sort_array(F.collect_list(F.struct("col_no", "title", "kinds"))).alias("columns"),
            F.max("last_row").alias("rows"),
        )
        .where("rows > 0")
    )


def sheet_table(
    rows: DataFrame,
    file: str,
    sheet: str,
    columns: Sequence,
    schema: T.StructType | None = None,
) -> DataFrame:
    """A sheet as a table: cleaned column names, given or seen types.

    ``columns`` is the ``columns`` value of the sheet's row in :func:`sheets`.
    A cell that does not fit a given schema becomes NULL.
    """
    columns = [c for c in columns if c["col_no"] is not None]
    titles = _titles([c["title"] for c in columns])
    names = [clean_name(t) for t in titles]
    require_distinct(names, "column")
    wanted = {f.name: f.dataType.simpleString() for f in schema.fields} if schema else {}
    fields = []
    for column, name in zip(columns, names, strict=True):
        seen = _TYPE_OF_KINDS.get(tuple(column["kinds"]), "string")
        cell = F.get("cells", F.lit(column["col_no"]))
        fields.append(cell.try_cast(wanted.get(name, seen)).alias(name))
    data = rows.where(
        (F.col("file") == file) & (F.col("sheet") == sheet) & (F.col("row_no") > 0)
    )
    return data.select(*fields)


def _titles(found: Sequence[str | None]) -> list[str]:
    """Header texts; blank ones are numbered, repeated ones get ``.1``, ``.2`` ..."""
    seen: dict[str, int] = {}
    out = []
    for i, title in enumerate(found):
        title = title if title not in (None, "") else f"Unnamed: {i}"
        times = seen.get(title, 0)
        seen[title] = times + 1
        out.append(f"{title}.{times}" if times else title)
    return out
