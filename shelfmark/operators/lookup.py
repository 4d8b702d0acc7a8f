"""Dimension key lookup for fact rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.keys import surrogate_key
from shelfmark.operators.statistics import known_bytes, row_bytes

# A frame is broadcast if its rows, unpacked, take at most this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class Dimension:
    """Names of a dimension: its surrogate key, business key and all attributes."""

    table: str
    key: str
    business: tuple[str, ...]
    attributes: tuple[str, ...]


def unpacked_bytes(df: DataFrame) -> int:
    """Size of the rows in memory. One distributed sum; nothing is collected but the result."""
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df is small enough for every executor to hold.

    Known without a job where it narrows a table that was measured when it
    was written, and that is small enough; else df is measured.
    """
    known = known_bytes(df)
    return (known is not None and known <= max_bytes) or unpacked_bytes(df) <= max_bytes


def versioned_keys(rows: DataFrame, dim: Dimension) -> DataFrame:
    """(business key, surrogate key) where a fact row cannot compute the key by itself.

    Business keys that own several dimension rows, or one whose key had to be
    replaced because it clashed.
    """
    several = rows.groupBy(*dim.business).agg(
        F.count(F.lit(1)).alias("_n"), F.max(_replaced(dim)).alias("_odd")
    )
    several = several.where("_n > 1 OR _odd")
    several = several.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(dim.business)])
    return rows.select(*dim.business, dim.key).join(
        several, _same(dim.business, several, null_safe=True), "left_semi"
    )


def _replaced(dim: Dimension) -> Column:
    return F.col(dim.key) != surrogate_key(dim.attributes)


def first_keys(rows: DataFrame, dim: Dimension) -> DataFrame:
    """One surrogate key per business key: that of the smallest attributes; ``_n`` > 1 where it must be looked up."""
    smallest = F.min(F.struct(*[F.col(c) for c in dim.attributes], F.col(dim.key)))
    return (
        rows.groupBy(*dim.business)
        .agg(
            smallest.alias("_first"),
            (F.when(F.max(_replaced(dim)), 2).otherwise(F.count(F.lit(1)))).alias("_n"),
        )
        .select(*dim.business, F.col(f"_first.{dim.key}").alias(dim.key), "_n")
    )


def attach_key(
    fact: DataFrame,
    rows: DataFrame,
    dim: Dimension,
    lookup: str = "as_is",
    method: str = "inline",
    null_safe: bool = False,
    own_key: Column | None = None,
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add ``dim.key`` to fact rows that carry the dimension's column names.

    The result is that of a left join on the business key:

    * ``lookup="as_is"`` - a fact row meets every dimension row of its business
      key, so a key with two versions yields two rows;
    * ``lookup="unique"`` - only the first version.

    A NULL in the business key matches nothing unless ``null_safe``.

    ``method="join"`` performs that join and takes any dimension table.
    ``method="inline"`` needs a dimension whose key is ``surrogate_key`` of its
    attributes and that covers the fact's source rows. Most business keys then
    own one dimension row, whose key the fact row computes by itself; only keys
    with several versions are looked up. With few of those the fact is not
    shuffled at all, whatever the size of the dimension.
    """
    if lookup not in ("as_is", "unique") or method not in ("inline", "join"):
        raise ValueError(f"unknown lookup {lookup!r} or method {method!r}")
    if method == "join":
        keys = rows.select(*dim.business, dim.key) if lookup == "as_is" else first_keys(rows, dim)
        return _left_lookup(fact, keys, dim, null_safe, dim.key)

    own = own_key if own_key is not None else surrogate_key(dim.attributes)
    if not null_safe:
        own = F.when(_all_known(dim.business), own)
    fact = fact.withColumn(dim.key, own)
    if set(dim.business) == set(dim.attributes):
        keys = rows.where(_replaced(dim)).select(*dim.business, dim.key)
    elif lookup == "as_is":
        keys = versioned_keys(rows, dim)
    else:
        keys = first_keys(rows, dim).where("_n > 1").drop("_n")
    # none: nothing to look up; few: broadcast; else shuffle join, skew split by AQE
    size = unpacked_bytes(keys)
    if size == 0:
        return fact
    if size <= max_broadcast_bytes:
        keys = F.broadcast(keys)
    found = _left_lookup(fact, keys, dim, null_safe, "_found")
    return found.withColumn(dim.key, F.coalesce("_found", dim.key)).drop("_found")


def _left_lookup(
    fact: DataFrame, keys: DataFrame, dim: Dimension, null_safe: bool, out: str
) -> DataFrame:
    renamed = keys.select(
        *[F.col(c).alias(f"_b{i}") for i, c in enumerate(dim.business)],
        F.col(dim.key).alias("_key"),
    )
    joined = fact.join(renamed, _same(dim.business, renamed, null_safe), "left")
    return joined.withColumn(out, F.col("_key")).drop(
        "_key", *[f"_b{i}" for i in range(len(dim.business))]
    )


def _same(business: Sequence[str], renamed: DataFrame, null_safe: bool) -> Column:
    out = F.lit(True)
    for i, c in enumerate(business):
        other = renamed[f"_b{i}"]
        out = out & (F.col(c).eqNullSafe(other) if null_safe else F.col(c) == other)
    return out


def _all_known(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out
