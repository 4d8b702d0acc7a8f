"""Sizes of written tables, counted while they were written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# folder of a written table -> its observation; read when a size is asked for
_written: dict[str, Observation] = {}

# what leaves rows no more and no wider than the table has them
_NARROWING = ("Project", "Filter", "SubqueryAlias", "LocalLimit", "GlobalLimit")


def row_bytes(df: DataFrame) -> Column:
    """Size of a row in memory: text as long as it is, 16 bytes for any other value."""
    text = [c for c, kind in df.dtypes if kind == "string"]
    fixed = 16 * (1 + len(df.columns))
    lengths = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c in text]
    return sum(lengths, F.lit(fixed).cast("long"))


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df, whose rows and bytes are counted by whatever writes it."""
    seen = Observation()
    measures = (F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes"))
    return df.observe(seen, *measures), seen


def remember(path: str, seen: Observation) -> None:
    """Keep what was observed while the folder was written."""
    _written[_plain(path)] = seen


def forget(path: str) -> None:
    """After a part of the table was rewritten."""
    _written.pop(_plain(path), None)


def known_bytes(df: DataFrame) -> int | None:
    """An upper bound of df's bytes, if it only narrows one table whose writing was observed."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in _NARROWING:
        plan = plan.children().apply(0)
    if plan.children().size() or not plan.nodeName().startswith(("LogicalRelation", "Relation")):
        return None
    relation = plan.relation()
    if not hasattr(relation, "location"):
        return None
    roots = relation.location().rootPaths()
    seen = _written.get(_plain(roots.apply(0).toString())) if roots.size() == 1 else None
    return None if seen is None else seen.get["bytes"]


def _plain(path: str) -> str:
    """The path without scheme and authority, as listings and settings spell it differently."""
    path = path.rstrip("/")
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return path
