"""Surrogate keys and one-row-per-key reduction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.ranking import amount_before

KEY_BITS = 64  # of a surrogate key; fewer make clashes, for tests


def surrogate_key(columns: Sequence[Column | str]) -> Column:
    """64-bit key that depends on the attribute values alone.

    Same rows give the same keys whatever the partitioning, so a fact row can
    compute the key of its dimension row without a join. The NULL flags keep
    ``(a, NULL)`` apart from ``(NULL, a)``. Two rows may share a key by chance
    (about n*n / 2**65); ``quality.key_clashes`` finds them, and
    :func:`settled_keys` gives all but one of them another.
    """
    parts = [p for c in columns for p in (F.isnull(c), c)]
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - KEY_BITS) if KEY_BITS < 64 else F.xxhash64(*parts)


def settled_keys(rows: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """rows with other keys for rows that share one: the smallest by its attributes keeps it.

    Only the rows of clashing keys are ordered, key by key. New keys may clash
    again, as rarely as any; check the result and repeat.
    """
    clashing = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(key)
    order = Window.partitionBy(key).orderBy(*[F.asc_nulls_first(c) for c in attributes])
    place = F.row_number().over(order)
    parts = [p for c in attributes for p in (F.isnull(c), c)]
    other = F.xxhash64(F.lit("again"), key, place, *parts)
    met = rows.join(clashing, key, "left_semi").withColumn("_new", F.when(place == 1, F.col(key)).otherwise(other))
    met = met.withColumn(key, F.col("_new")).select(*rows.columns)
    return rows.join(clashing, key, "left_anti").select(*rows.columns).unionByName(met)


def add_dense_key(df: DataFrame, name: str, order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Number the rows 1..n in the given order, slice-wise, without one big sort task.

    The order columns must identify a row.
    """
    numbered = amount_before(
        df.withColumn("_one", F.lit(1)),
        [F.asc_nulls_last(c) for c in order],
        weight="_one",
        name="_before",
        slices=slices,
    )
    return numbered.withColumn(name, F.col("_before") + 1).select(name, *df.columns)


def unique_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by its other columns (NULL first).

    An aggregate, so a key with very many versions shrinks before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    first = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_first"))
    return first.select(*key, "_first.*").select(*df.columns)
