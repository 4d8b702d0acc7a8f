"""Source folder listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File suffix -> how it is read. Suffixes are matched in any case.
KIND_OF_SUFFIX = {"xlsx": "workbook", "csv": "csv", "xls": "legacy_workbook"}


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file, stem, length, kind) of the files directly in a folder.

    Only the listing is read: file content is a column that is not selected.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.lit("unsupported")
    for known, how in KIND_OF_SUFFIX.items():
        kind = F.when(suffix == known, how).otherwise(kind)
    return files.select(
        "path",
        name.alias("file"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        "length",
        kind.alias("kind"),
    )
