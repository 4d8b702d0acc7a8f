"""A Bloom filter as a column expression: built and read inside the plan, no job before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES = 3
LOG_BITS = (14, 23)  # 2 KB to 1 MB


def filter_size(df: DataFrame) -> int:
    """log2 of the bits for the rows of df, from the optimizer's size estimate, within LOG_BITS."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least, most = LOG_BITS
    return min(max(estimate.bit_length(), least), most)


def _place(key: Column, probe: int, log_bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(probe)), 64 - log_bits)


def might_contain(values: DataFrame, key: str, probed: Column, log_bits: int | None = None) -> Column:
    """False only where ``probed`` is surely not among ``values[key]``; NULL is not.

    The filter is a scalar subquery: one array of 2 ** (log_bits - 6) words,
    merged by bit_or where the values are. Whatever it holds, its size is
    fixed; a fuller one lets more rows through to the exact join behind it.
    """
    log_bits = filter_size(values) if log_bits is None else log_bits
    probes = F.explode(F.array(*[_place(F.col(key), p, log_bits) for p in range(PROBES)]))
    bits = values.where(F.col(key).isNotNull()).select(probes.alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("mask")
    )
    every = values.sparkSession.range(1 << (log_bits - 6)).join(words, "id", "left")
    pairs = F.sort_array(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))))
    table = every.agg(F.transform(pairs, lambda x: x["mask"]).alias("words")).scalar()
    found = probed.isNotNull()
    for p in range(PROBES):
        place = _place(probed, p, log_bits)
        word = F.get(table, F.shiftright(place, 6).cast("int"))
        bit = F.call_function("shiftright", word, place.bitwiseAND(F.lit(63).cast("long")).cast("int"))
        found = found & (bit.bitwiseAND(F.lit(1).cast("long")) == 1)
    return found
