"""Raw and star tables of a source folder, staged on first use."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators import stage
from shelfmark.plans.pipeline import mart_plans, star_plans
from shelfmark.sources import raw_orders, raw_people, raw_returns

SOURCE_TABLES = ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")


class StagedTables(Mapping[str, DataFrame]):
    """Tables by name; a table is computed and written when first asked for."""

    def __init__(self, plans: dict[str, Callable[[], DataFrame]]):
        self.plans = plans
        self.written: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.written:
            self.written[name] = stage(self.plans[name](), name, measured=True, compression="zstd")
        return self.written[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.plans)

    def __len__(self) -> int:
        return len(self.plans)


@dataclass(frozen=True)
class Workspace:
    raw: StagedTables
    star: StagedTables
    gold: StagedTables


_open: dict[tuple, Workspace] = {}


def open_workspace(spark: SparkSession, folder: str, **ltv_options) -> Workspace:
    """The flat raw tables, the star schema and the marts over the tables of a folder.

    The line-grain join and the key lookups are the expensive part of every
    mart, and the marts that of every report, so each is written once and
    shared: a report is one scan of a stored mart. Changed source files give
    a new workspace.
    """
    options = tuple(sorted(ltv_options.items()))
    key = (spark.sparkContext.applicationId, folder, options, _state(spark, folder))
    if key not in _open:
        for old in [k for k in _open if k[0] != key[0] or k[:3] == key[:3]]:
            del _open[old]  # another application's, or built on files that have changed
        raw = StagedTables(
            {
                "orders": lambda: raw_orders(spark, folder),
                "people": lambda: raw_people(spark, folder),
                "returns": lambda: raw_returns(spark, folder),
            }
        )
        star = StagedTables({})
        star.plans.update(star_plans(raw, star))
        gold = StagedTables({name: partial(plan, star) for name, plan in mart_plans(**ltv_options).items()})
        _open[key] = Workspace(raw, star, gold)
    return _open[key]


def _state(spark: SparkSession, folder: str) -> tuple:
    """(file, size, modification time) of the source files; a listing, no job."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = []
    for name in SOURCE_TABLES:
        path = hadoop.Path(f"{folder}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in fs.listStatus(path):
            out.append((str(found.getPath()), found.getLen(), found.getModificationTime()))
    return tuple(out)
