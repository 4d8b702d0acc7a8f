"""Positions over a whole table without sending it to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.staging import stage

MOST_SLICES = 256  # of a rank: more would only lengthen the plan


def amount_before(
    df: DataFrame,
    order: Sequence[Column],
    weight: str,
    name: str,
    slices: int | None = None,
) -> DataFrame:
    """Add the sum of ``weight`` over all rows that come earlier in ``order``.

    Range slices are written once, so slice numbers cannot move between the two
    reads. Each slice adds up its own rows; what precedes a slice comes from a
    table of one row per slice, which is all that is sorted in one task or
    broadcast. The order columns must be distinct per row.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id())
    sliced = stage(sliced, "slices")
    earlier_slices = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy("_slice")
        .agg(F.sum(weight).alias("_sum"))
        .select("_slice", F.coalesce(F.sum("_sum").over(earlier_slices), F.lit(0)).alias("_start"))
    )
    earlier_rows = (
        Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        sliced.join(F.broadcast(starts), "_slice")  # at most n rows
        .withColumn(name, F.col("_start") + F.coalesce(F.sum(weight).over(earlier_rows), F.lit(0)))
        .drop("_slice", "_start")
    )


def global_rank(
    df: DataFrame,
    ranks: dict[str, str],
    slices: int | None = None,
) -> DataFrame:
    """Add competition ranks, highest value first, equal values sharing a rank, NULL last.

    ``ranks`` maps value column -> rank column. ``df`` is read several times, so
    hand in a staged frame.

    One pass takes quantile sketches of all measures; their cut points deal
    each measure's distinct values (with the number of rows that have them)
    into slices. A slice adds up its own rows, and a table of one row per slice
    says what precedes it. Cut points are plain numbers in the plan, so slices
    are the same on every read and nothing is written in between.
    """
    n = min(slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_SLICES)
    shares = [i / n for i in range(1, n)]
    cuts = [F.percentile_approx(v, shares, 100 * n).alias(name) for v, name in ranks.items()]
    found = df.agg(*cuts).first() if n > 1 else {}  # n numbers a measure
    for value, name in ranks.items():
        points = sorted(set(found[name] or [])) if n > 1 else []
        column = F.col("_value")
        # values above all cut points are in slice 0, NULL is in one of its own
        above = [F.when(column <= F.lit(p), 1).otherwise(0) for p in points]
        place = sum(above, F.lit(0))
        place = F.when(column.isNull(), len(points) + 1).otherwise(place)
        counts = df.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
        counts = counts.withColumn("_slice", place)
        starts = counts.groupBy("_slice").agg(F.sum("_rows").alias("_all"))
        earlier_slices = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.select("_slice", F.coalesce(F.sum("_all").over(earlier_slices), F.lit(0)).alias("_start"))
        earlier = Window.partitionBy("_slice").orderBy(F.desc_nulls_last("_value"))
        earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
        places = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        places = places.join(F.broadcast(starts), "_slice")  # n + 1 rows at most
        places = places.select("_value", (F.col("_start") + F.col("_before") + 1).cast("int").alias(name))
        df = df.join(places, F.col(value).eqNullSafe(F.col("_value")), "left").drop("_value")
    return df
