"""Dashboard figures from a declaration: a dataset, its fields, and whether rows are kept apart."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A result column and the SQL expression that gives it."""

    name: str
    expression: str


@dataclass(frozen=True)
class Widget:
    """What a figure shows.

    ``disaggregated`` keeps one result row per row; otherwise the fields that
    aggregate are grouped by those that do not, and by nothing if all do.
    """

    dataset: str
    fields: Sequence[Field]
    disaggregated: bool = False

    def frame(self, datasets: Mapping[str, DataFrame]) -> DataFrame:
        """The declaration as one DataFrame plan; ValueError if it does not hold together."""
        if self.dataset not in datasets:
            raise ValueError(f"unknown dataset {self.dataset!r}")
        names = [f.name for f in self.fields]
        if not names or len(set(names)) < len(names):
            raise ValueError("fields need names of their own")
        rows = datasets[self.dataset]
        columns = {f.name: F.expr(f.expression).alias(f.name) for f in self.fields}
        grouped = [n for n in names if not _aggregates(rows, self.fields[names.index(n)].expression)]
        if self.disaggregated:
            if len(grouped) < len(names):
                raise ValueError("a field aggregates, but rows are to be kept apart")
            return rows.select(*columns.values())
        measures = [columns[n] for n in names if n not in grouped]
        if not measures:
            return rows.select(*columns.values()).distinct()
        return rows.groupBy(*[columns[n] for n in grouped]).agg(*measures).select(*[F.col(f"`{n}`") for n in names])


def _aggregates(rows: DataFrame, expression: str) -> bool:
    """Whether Spark plans the expression as an aggregate. Nothing is run."""
    plan = rows.select(F.expr(expression))._jdf.queryExecution().analyzed()
    return plan.nodeName() == "Aggregate"
