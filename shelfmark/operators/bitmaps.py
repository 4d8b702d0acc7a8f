"""Distinct counts that can be merged: exact bitmaps over dense numbers, and sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.keys import add_dense_key


def new_numbers(values: DataFrame, known: DataFrame | None, by: Sequence[str] = ()) -> DataFrame:
    """(value, number) of values that ``known`` does not have, numbered on from its highest.

    ``values`` has a column ``value``; NULL gets no number. Numbers are dense,
    so bitmaps over them stay full whatever the values look like. Values are
    numbered in the order of the smallest ``by`` they occur with: bitmaps per
    ``by`` then take few buckets, where numbers without order would leave
    some bits of all buckets to each.
    """
    fresh = values.where("value IS NOT NULL")
    if by:
        fresh = fresh.groupBy("value").agg(F.min(F.struct(*by)).alias("first")).select("value", "first.*")
    else:
        fresh = fresh.select("value").distinct()
    order = [*by, "value"]
    if known is None:
        return add_dense_key(fresh, "number", order).select("value", "number")
    fresh = fresh.join(known, "value", "left_anti")
    highest = F.coalesce(known.agg(F.max("number")).scalar(), F.lit(0))
    return add_dense_key(fresh, "place", order).select("value", (F.col("place") + highest).alias("number"))


def bitmaps(rows: DataFrame, keys: Sequence[str], number: str = "number") -> DataFrame:
    """keys, bucket, bits: which numbers occur per group, in bitmaps of 32,768 numbers (4 KB).

    Numbers move to their bitmap, and not bitmaps that every task has begun: of
    these, 4 KB each, there may be as many as rows.
    """
    placed = rows.select(
        *keys, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("position")
    )
    placed = placed.repartition(*keys, "bucket")
    return placed.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("position").alias("bits"))


def count_bitmaps(maps: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Exact distinct count per group of ``keys``, any part of the keys the bitmaps were built by."""
    merged = maps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))


def sketches(rows: DataFrame, keys: Sequence[str], column: str, log_size: int = 12) -> DataFrame:
    """keys, sketch: HyperLogLog of the column per group; 2 ** log_size registers, error about 0.8 / sqrt of that."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(column, F.lit(log_size)).alias("sketch"))


def count_sketches(found: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Approximate distinct count per group of ``keys``, any part of the sketches' keys."""
    merged = found.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*keys, F.hll_sketch_estimate("sketch").alias(name))

