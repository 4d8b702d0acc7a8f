"""Grouped measures with exact distinct counts, planned for little shuffling."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.measures import Measure
from shelfmark.operators.lookup import BROADCAST_BYTES, fits_broadcast


@dataclass(frozen=True)
class Lookup:
    """Group attributes found through a key: ``rows LEFT JOIN dim ON rows.on = dim.on``."""

    on: str
    dim: DataFrame

    @property
    def attributes(self) -> list[str]:
        return [c for c in self.dim.columns if c != self.on]


@dataclass(frozen=True)
class Grouping:
    """What :func:`aggregate` works on: rows, keys, measures, distinct counts and lookups."""

    rows: DataFrame
    keys: Sequence[str]
    measures: Mapping[str, Measure]
    distinct: Mapping[str, str]
    lookups: Sequence[Lookup] = ()
    counted: DataFrame | None = None

    def aggregated(self, max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        return aggregate(
            self.rows,
            self.keys,
            self.measures,
            self.distinct,
            self.lookups,
            max_broadcast_bytes,
            self.counted,
        )


def aggregate(
    rows: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Measure],
    distinct: Mapping[str, str],
    lookups: Sequence[Lookup] = (),
    max_broadcast_bytes: int = BROADCAST_BYTES,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Group rows by keys: measures, and a count of distinct values per ``distinct`` entry.

    One aggregate over both would send the wide measure buffers through the
    exchange that separates the distinct values (and, with two distinct
    columns, expand every row first). Here the measures shrink to the groups
    before their only exchange, and each distinct count moves narrow rows. The
    results share the partitioning of the group columns, so putting them
    together moves nothing.

    Keys may be attributes of lookup dimensions. Fact rows meet a dimension as
    (key, group name) and are grouped by two numbers; the attributes join the
    finished groups. A dimension measured to be small is broadcast. To a larger
    one the rows move once, with the columns they need, and AQE splits a skewed
    key: aggregating by its key first would move wide partial sums twice, and
    with about as many keys and groups as rows they are no fewer.

    ``counted`` gives the rows for the distinct counts, if ``rows`` has joins
    that only the measures need.
    """
    counted = rows if counted is None else counted
    labels: dict[tuple[str, str], DataFrame] = {}
    for i, lookup in enumerate(lookups):
        name = (f"_group{i}", f"_check{i}")
        named = _named(lookup, name)
        # no larger than the dimension, either of the two
        sent = F.broadcast if fits_broadcast(lookup.dim, max_broadcast_bytes) else (lambda df: df)
        met = sent(named.select(lookup.on, *name))
        rows = _with_group(rows, met, lookup.on, name)
        counted = _with_group(counted, met, lookup.on, name)
        labels[name] = sent(named.select(*name, *lookup.attributes).distinct())

    plain = [k for k in keys if not any(k in lookup.attributes for lookup in lookups)]
    measured, stand_ins = _with_stand_ins(rows, plain)
    counted, _ = _with_stand_ins(counted, plain)

    groups = [*[c for name in labels for c in name], *stand_ins]
    out = measured.groupBy(*groups).agg(*[m.whole.alias(n) for n, m in measures.items()])
    for name, column in distinct.items():
        counts = counted.groupBy(*groups).agg(F.count_distinct(column).alias(name))
        out = out.join(counts, groups)  # both sides hold every group once
    for name, attributes in labels.items():
        out = out.join(attributes, list(name), "left")
    for i, key in enumerate(plain):
        out = out.withColumn(key, F.when(~F.col(f"_null{i}"), F.col(f"_key{i}")))
    return out.select(*keys, *measures, *distinct)


CUTS = 64  # a key that fills the space between two of so many cut points of the rows is frequent
DEALT = 64  # tasks for the rows of such a key


def aggregate_by_key(
    rows: DataFrame, key: str, measures: Mapping[str, Measure], name: str, distinct: str
) -> DataFrame:
    """Group rows by a key of which a task sees few rows each: measures, and distinct values as ``name``.

    Partial sums of such a key are about as many as its rows and wider, so the
    rows themselves move, once, with the columns they need; sums and distinct
    values are taken where they then are. Rows of frequent keys are dealt by
    their distinct value over DEALT tasks, and the parts merged.
    """
    mark = F.shiftrightunsigned(F.xxhash64(key), 12)  # as exact as a double; NULL has one, too
    points = [i / CUTS for i in range(CUTS + 1)]
    cuts = rows.agg(F.percentile_approx(mark, points, 1000)).first()[0] or []  # a number per cut
    frequent = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    if not frequent:
        moved = rows.repartition(F.col(key))
        whole = [m.whole.alias(n) for n, m in measures.items()]
        return moved.groupBy(key).agg(*whole, F.count_distinct(distinct).alias(name))

    place = F.when(mark.isin(frequent), F.pmod(F.xxhash64(distinct), F.lit(DEALT))).otherwise(0)
    moved = rows.withColumn("_place", place).repartition(F.col(key), F.col("_place"))
    parts = [p.alias(f"{n}__{i}") for n, m in measures.items() for i, p in enumerate(m.parts)]
    # equal distinct values are in one place
    placed = moved.groupBy(key, "_place").agg(*parts, F.count_distinct(distinct).alias(name))
    merged = [m.merge(*[F.col(f"{n}__{i}") for i in range(len(m.parts))]).alias(n) for n, m in measures.items()]
    return placed.groupBy(key).agg(*merged, F.sum(name).alias(name))


def _named(lookup: Lookup, name: tuple[str, str]) -> DataFrame:
    """A dimension with 128 bits that stand for the combination of its attributes.

    Computed row by row: nothing is sorted or gathered to give out numbers. All
    attributes NULL is (0, 0), where rows without a match belong too.
    """
    known = reduce(Column.__or__, [F.col(c).isNotNull() for c in lookup.attributes])
    parts = [p for c in lookup.attributes for p in (F.isnull(c), F.col(c))]
    seeds = ([], [F.lit("check")])
    zero = F.lit(0).cast("long")
    return lookup.dim.withColumns(
        {n: F.when(known, F.xxhash64(*seed, *parts)).otherwise(zero) for n, seed in zip(name, seeds, strict=True)}
    )


def _with_group(rows: DataFrame, named: DataFrame, on: str, name: tuple[str, str]) -> DataFrame:
    joined = rows.join(named, on, "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in name})


def _with_stand_ins(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Per key a never-NULL value and a NULL flag: groups that plain equality can join."""
    added: dict[str, Column] = {}
    for i, key in enumerate(keys):
        kind = rows.schema[key].dataType
        added[f"_key{i}"] = F.coalesce(F.col(key), F.lit(_blank(kind)).cast(kind))
        added[f"_null{i}"] = F.isnull(F.col(key))
    return rows.withColumns(added) if added else rows, list(added)


def _blank(kind: T.DataType) -> object:
    if isinstance(kind, T.StringType):
        return ""
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return dt.date(1970, 1, 1)
    return False if isinstance(kind, T.BooleanType) else 0
