"""Table and column naming."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blank and hyphen become "_", parentheses are dropped.
_MATCH = " -()"
_REPLACE = "__"
_TABLE = str.maketrans(_MATCH[:2], _REPLACE, _MATCH[2:])


def clean_name(name: str) -> str:
    """``" Sub-Category (EU)"`` -> ``sub_category_eu``; other symbols stay."""
    return name.strip().lower().translate(_TABLE)


def clean_expr(col: Column | str) -> Column:
    """The same rule on a string column."""
    stripped = F.regexp_replace(col, r"^\s+|\s+$", "")
    return F.translate(F.lower(stripped), _MATCH, _REPLACE)


def clean_columns(df: DataFrame) -> DataFrame:
    """Rename every column by :func:`clean_name`; two columns on one name is an error."""
    names = [clean_name(c) for c in df.columns]
    require_distinct(names, "column")
    return df.toDF(*names)


def require_distinct(names: list[str], what: str) -> None:
    clashes = sorted(n for n, times in Counter(names).items() if times > 1)
    if clashes:
        raise ValueError(f"{what} names collide after cleaning: {', '.join(clashes)}")


def table_kind(name: Column | str) -> Column:
    """DIMENSION for ``dim_*`` tables, FACT for the rest."""
    return F.when(F.startswith(name, F.lit("dim_")), "DIMENSION").otherwise("FACT")
