"""Cells and rows that cannot be read, counted in the pass that writes them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def read_date(text: Column, formats: Sequence[str] = ()) -> Column:
    """A timestamp by the first format that fits, then by Spark's own reading of ISO dates; NULL if none does."""
    tried = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*tried, text.try_cast("timestamp"))


class Rejects:
    """Counts, per column, cells that were there before reading and are NULL after; and corrupt rows.

    ``apply`` gives the frame to write; ``counts`` tells after it was written.
    """

    def __init__(self, dates: Mapping[str, Sequence[str]] | None = None):
        self.dates = dict(dates or {})
        self.seen: Observation | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """df with its text dates read, without the column of corrupt rows."""
        kinds = dict(df.dtypes)
        text = {c: f for c, f in self.dates.items() if kinds.get(c) == "string"}
        missing = sorted(set(self.dates) - set(kinds))
        if missing:
            raise ValueError(f"no such date columns: {missing}")
        read = {f"_read_{i}": read_date(F.col(f"`{c}`"), f) for i, (c, f) in enumerate(text.items())}
        counted = {}
        for i, c in enumerate(text):
            there = F.col(f"`{c}`").isNotNull() & (F.btrim(F.col(f"`{c}`")) != "")
            counted[c] = F.count_if(there & F.col(f"_read_{i}").isNull())
        if CORRUPT in kinds:
            counted["row"] = F.count_if(F.col(CORRUPT).isNotNull())
        if not counted:
            return df
        self.seen = Observation()
        observed = df.withColumns(read).observe(self.seen, *[n.alias(c) for c, n in counted.items()])
        names = {c: f"_read_{i}" for i, c in enumerate(text)}
        return observed.select(
            *[F.col(names[c] if c in names else f"`{c}`").alias(c) for c in df.columns if c != CORRUPT]
        )

    def counts(self) -> dict[str, int]:
        """Column (or ``row``) -> how many were rejected, none of them zero. Waits for the write."""
        return {} if self.seen is None else {c: n for c, n in self.seen.get.items() if n}


class Rejected(ValueError):
    """Some cells or rows could not be read."""

    def __init__(self, source: str, counts: Mapping[str, int]):
        super().__init__(f"{source}: could not read " + ", ".join(f"{n} x {c}" for c, n in sorted(counts.items())))
        self.source, self.counts = source, dict(counts)
