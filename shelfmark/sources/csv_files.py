"""CSV source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from shelfmark.functions import clean_columns
from shelfmark.functions.naming import clean_name, require_distinct
from shelfmark.sources.rejects import CORRUPT


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    clean: bool = True,
    keep_corrupt: bool = False,
    **options: str,
) -> DataFrame:
    """CSV with a header line. A given schema saves the pass that infers one.

    With a schema and ``keep_corrupt``, a row that does not fit it keeps its text
    in one more column, ``CORRUPT``, for ``Rejects`` to count.
    """
    reader = spark.read.option("header", "true").options(**options)
    if schema is None:
        df = reader.option("inferSchema", "true").csv(path)
        return clean_columns(df) if clean else df
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if keep_corrupt:
        schema = StructType([*schema.fields, StructField(CORRUPT, StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    df = reader.schema(schema).csv(path)
    return _cleaned(df) if clean else df


def _cleaned(df: DataFrame) -> DataFrame:
    """Clean names for all columns but that of corrupt rows."""
    names = [c if c == CORRUPT else clean_name(c) for c in df.columns]
    require_distinct([c for c in names if c != CORRUPT], "column")
    return df.toDF(*names)
