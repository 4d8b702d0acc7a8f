"""Stored marts that are refreshed in part: mergeable state per partition of the fact.

For every mart a state table holds, per month of the fact and group, the parts
of its measures (sums, counts, extremes) and what its distinct counts need. A
replaced month rewrites its own rows of the state; marts are merged from the
state and never read the fact.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import Grouping
from shelfmark.operators.bitmaps import (
    bitmaps,
    count_bitmaps,
    count_sketches,
    new_numbers,
    sketches,
)
from shelfmark.plans import marts

MONTH = "order_month"

BITMAPS = "bitmaps"  # exact; for marts of few groups
PAIRS = "pairs"  # exact; one row per month, group and value: for groups with few values each
SKETCHES = "sketches"  # approximate

# mart -> groups of the fact, what is made of them, how distinct values are kept
GroupsOf = Callable[[Mapping[str, DataFrame]], Grouping]


@dataclass(frozen=True)
class StoredMart:
    groups: GroupsOf
    finish: Callable[..., DataFrame]
    distinct: str = BITMAPS


MARTS: Mapping[str, StoredMart] = {
    "agg_monthly_sales": StoredMart(marts.months, marts.monthly_sales),
    "agg_customer_lifetime_value": StoredMart(
        marts.customers,
        lambda t, groups, **options: marts.customer_lifetime_value(t, spend=groups, **options),
        PAIRS,
    ),
    "agg_product_performance": StoredMart(marts.products, marts.product_performance, PAIRS),
    "agg_regional_summary": StoredMart(
        marts.regions, lambda t, groups: marts.regional_summary(t, by_region=groups)
    ),
    "agg_category_trends": StoredMart(
        marts.categories, lambda t, groups, **options: marts.category_trends(t, quarterly=groups, **options)
    ),
    "agg_shipping_analysis": StoredMart(marts.ship_modes, marts.shipping_analysis),
    "agg_state_performance": StoredMart(
        marts.states, lambda t, groups: marts.state_performance(t, by_state=groups)
    ),
}


def month_of(date_key: Column | str = "order_date_key") -> Column:
    """The partition of a fact row: year and month of its order; 0 without a date."""
    return F.coalesce(F.expr(f"CAST({date_key} DIV 100 AS INT)"), F.lit(0))


def with_month(fact: DataFrame) -> DataFrame:
    """The fact with its partition column, for a sink that partitions by it."""
    return fact.withColumn(MONTH, month_of())


def with_fact(star: Mapping[str, DataFrame], fact: DataFrame) -> Mapping[str, DataFrame]:
    """The star schema with other sales; no other table is taken from it before it is read."""
    return ChainMap({"fact_sales": fact}, star)


def in_years(star: Mapping[str, DataFrame], *years: int) -> Mapping[str, DataFrame]:
    """The star schema with the sales of some years, found through the date dimension.

    On a fact that is stored by month, the semi join prunes partitions while it
    runs: only months that the date dimension has for these years are opened.
    """
    days = star["dim_date"].where(F.col("year").isin([int(y) for y in years]))
    months = days.select(month_of("date_key").alias(MONTH)).distinct()
    fact = star["fact_sales"] if MONTH in star["fact_sales"].columns else with_month(star["fact_sales"])
    # 12 rows a year
    return with_fact(star, fact.join(F.broadcast(months), MONTH, "left_semi"))


class GoldStore:
    """State tables below ``root`` and the marts merged from them.

    ``star`` maps table names to frames, as the marts take them. A fact stored
    by partitions of ``order_month`` is read by those partitions alone.
    """

    def __init__(self, spark: SparkSession, root: str, specs: Mapping[str, StoredMart] = MARTS):
        self.spark, self.root, self.specs = spark, root.rstrip("/"), dict(specs)

    # --- state

    def refresh(self, star: Mapping[str, DataFrame], months: Sequence[int] | None = None) -> None:
        """Rewrite the state of some months of the fact, or of all.

        A month without rows any more has no state afterwards. A run that is cut
        off may be repeated: it replaces whole partitions.
        """
        fact = star["fact_sales"]
        if MONTH not in fact.columns:
            fact = with_month(fact)
        if months is not None:
            fact = fact.where(F.col(MONTH).isin([int(m) for m in months]))
        part = with_fact(star, fact)
        numbered = {
            column for spec in self.specs.values() if spec.distinct == BITMAPS
            for column in spec.groups(part).distinct.values()
        }
        for column in sorted(numbered):
            self._number(fact, column)
        for name, spec in self.specs.items():
            groups = spec.groups(part)
            self._write(self._parts(groups), name, months)
            for counted, column in groups.distinct.items():
                found = self._values(groups, column, spec.distinct)
                self._write(found, f"{name}.{counted}", months)

    def _parts(self, groups: Grouping) -> DataFrame:
        """Parts of all measures per month and group."""
        parts = [
            part.alias(f"{name}__{i}")
            for name, measure in groups.measures.items()
            for i, part in enumerate(measure.parts)
        ]
        return _placed(groups, groups.rows).groupBy(MONTH, *groups.keys).agg(*parts)

    def _values(self, groups: Grouping, column: str, kind: str) -> DataFrame:
        rows = _placed(groups, groups.rows if groups.counted is None else groups.counted)
        keys = [MONTH, *groups.keys]
        if kind == SKETCHES:
            return sketches(rows, keys, column)
        pairs = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("value"))
        if kind == PAIRS:
            return pairs.distinct()
        # rows that met by value are distinct where they are
        return bitmaps(pairs.join(self._numbers(column), "value").distinct(), keys)

    def _number(self, fact: DataFrame, column: str) -> None:
        """Give numbers to values that have none, month by month; numbers that were given stay."""
        path = f"{self.root}/numbers/{column}"
        values = fact.select(F.col(column).alias("value"), MONTH)
        known = self.spark.read.parquet(path) if self._exists(path) else None
        new_numbers(values, known, [MONTH]).write.mode("append").parquet(path)

    def _numbers(self, column: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/numbers/{column}")

    def _write(self, df: DataFrame, name: str, months: Sequence[int] | None) -> None:
        path = f"{self.root}/state/{name}"
        if months is not None and self._exists(path):
            for month in months:
                self._delete(f"{path}/{MONTH}={int(month)}")
            mode = "append"
        else:
            mode = "overwrite"
        df.hint("rebalance", F.col(MONTH)).write.mode(mode).partitionBy(MONTH).parquet(path)

    # --- marts

    def groups(self, name: str, star: Mapping[str, DataFrame]) -> DataFrame:
        """The mart's groups, merged over all months."""
        spec = self.specs[name]
        form = spec.groups(star)  # names and merge expressions; nothing of the fact is read
        merged = {
            measure: m.merge(*[F.col(f"{measure}__{i}") for i in range(len(m.parts))]).alias(measure)
            for measure, m in form.measures.items()
        }
        out = self._state(name).groupBy(*form.keys).agg(*merged.values())
        for counted in form.distinct:
            counts = self.distinct_counts(name, counted, form.keys)
            named = counts.select(*[F.col(k).alias(f"_{k}") for k in form.keys], F.col(counted))
            same = F.lit(True)
            for k in form.keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            out = out.join(named, same, "left").drop(*[f"_{k}" for k in form.keys])
            out = out.withColumn(counted, F.coalesce(counted, F.lit(0).cast("long")))
        return out.select(*form.keys, *form.measures, *form.distinct)

    def distinct_counts(self, name: str, counted: str, keys: Sequence[str]) -> DataFrame:
        """A distinct count by any part of the mart's keys: merged, not added up, so nothing counts twice."""
        state, kind = self._state(f"{name}.{counted}"), self.specs[name].distinct
        if kind == BITMAPS:
            return count_bitmaps(state, keys, counted)
        if kind == SKETCHES:
            return count_sketches(state, keys, counted)
        return state.groupBy(*keys).agg(F.count_distinct("value").alias(counted))

    def mart(self, name: str, star: Mapping[str, DataFrame], **options) -> DataFrame:
        """The mart, from the state, the dimensions and, where it has them, the returns."""
        return self.specs[name].finish(star, self.groups(name, star), **options)

    def _state(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/state/{name}")

    # --- files

    def _exists(self, path: str) -> bool:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found)

    def _delete(self, path: str) -> None:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(found, True)


def _placed(groups: Grouping, rows: DataFrame) -> DataFrame:
    """Rows with the attributes of the lookups their groups need."""
    for lookup in groups.lookups:
        rows = rows.join(lookup.dim, lookup.on, "left")
    return rows
