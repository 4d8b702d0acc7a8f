"""Running sums over a whole sorted table, without sending it to one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators import stage


def sums_before(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """Add, per entry of ``sums``, the sum of the column over all rows earlier in ``order``.

    Range slices are written once, so a row's slice is fixed; a slice adds up
    its own rows, and what precedes it comes from a table of one row per slice.
    Rows equal in ``order`` must be interchangeable. A range cannot part rows
    that are equal in all of ``order``, so end it with a row number.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = {f"part_{i}": c for i, c in enumerate(sums.values())}
    sliced = df.withColumns(parts).repartitionByRange(n, *order)
    sliced = stage(sliced.withColumn("slice_", F.spark_partition_id()), "slices")
    earlier = Window.orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy("slice_")
        .agg(*[F.sum(p).alias(p) for p in parts])
        .select("slice_", *[F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(f"start_{p}") for p in parts])
    )
    within = Window.partitionBy("slice_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = sliced.join(F.broadcast(starts), "slice_")  # at most n rows
    added = {
        name: F.col(f"start_{p}") + F.coalesce(F.sum(p).over(within), F.lit(0))
        for name, p in zip(sums, parts, strict=True)
    }
    return joined.withColumns(added).drop("slice_", *parts, *[f"start_{p}" for p in parts])
