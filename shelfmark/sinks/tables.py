"""Table sinks. A frame is executed once: rows are counted while they are written."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.statistics import forget, observed, remember


# rows of many sheets in one table: each sheet reads its own partition
PARTITIONS = {"workbook_rows": ("file", "sheet")}


@dataclass(frozen=True)
class Written:
    """What a write did."""

    table: str
    rows: int
    columns: int


def materialize(
    df: DataFrame,
    table: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> tuple[DataFrame, Written]:
    """Save df as a table and return it as written, with its row count.

    A partitioned write is rebalanced by the partition columns first: few files
    per partition, and a partition that holds much of the data is split over
    tasks by AQE.
    """
    counted, seen = observed(_rebalanced(df, partition_by))
    writer = counted.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)
    return df.sparkSession.table(table), Written(table, seen.get["rows"], len(df.columns))


def replace_partitions(df: DataFrame, table: str) -> Written:
    """Overwrite only the partitions of an existing table that df has rows for."""
    target = df.sparkSession.table(table)
    counted, seen = observed(df.select(*target.columns))
    # a session setting: insertInto does not take it as a write option
    conf, mode = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(mode)
    conf.set(mode, "dynamic")
    try:
        counted.write.insertInto(table, overwrite=True)
    finally:
        conf.set(mode, before)
    return Written(table, seen.get["rows"], len(df.columns))


def _rebalanced(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.hint("rebalance", *[F.col(c) for c in by]) if by else df


@dataclass
class TableSink:
    """Writes each layer's tables into a schema of the session catalog."""

    spark: SparkSession
    schemas: Mapping[str, str]
    partition_by: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(PARTITIONS))
    log: list[tuple[str, Written]] = field(default_factory=list)

    def __call__(self, layer: str, name: str, df: DataFrame) -> DataFrame:
        schema = self.schemas[layer]
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
        saved, written = materialize(
            df, f"{schema}.{name}", partition_by=self.partition_by.get(name, ())
        )
        self.log.append((layer, written))
        return saved


@dataclass
class FolderSink:
    """Writes each layer's tables as Parquet below a folder.

    Tables named in ``partition_by`` are partitioned by those columns;
    :meth:`replace` then rewrites only the partitions that a frame has rows for.
    """

    spark: SparkSession
    root: str
    partition_by: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(PARTITIONS))
    log: list[tuple[str, Written]] = field(default_factory=list)

    def __call__(self, layer: str, name: str, df: DataFrame) -> DataFrame:
        return self._saved(layer, name, df, "static")

    def replace(self, layer: str, name: str, df: DataFrame) -> DataFrame:
        """The table after its partitions in df are replaced."""
        if not self.partition_by.get(name):
            raise ValueError(f"{name} has no partitions to replace")
        return self._saved(layer, name, df, "dynamic")

    def _saved(self, layer: str, name: str, df: DataFrame, mode: str) -> DataFrame:
        path = f"{self.root.rstrip('/')}/{layer}/{name}"
        by = self.partition_by.get(name, ())
        counted, seen = observed(_rebalanced(df, by))
        writer = counted.write.mode("overwrite").option("partitionOverwriteMode", mode)
        (writer.partitionBy(*by) if by else writer).parquet(path)
        if mode == "static":
            remember(path, seen)
        else:  # a replaced partition says nothing about the whole
            forget(path)
        self.log.append((layer, Written(name, seen.get["rows"], len(df.columns))))
        return self.spark.read.schema(df.schema).parquet(path)
