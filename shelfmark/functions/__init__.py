from shelfmark.functions.calendar import calendar_columns, date_key
from shelfmark.functions.labels import days_label, money_label, percent_label
from shelfmark.functions.measures import (
    band,
    growth_pct,
    guarded_ratio,
    mean,
    percent,
    ratio,
    total,
)
from shelfmark.functions.naming import clean_columns, clean_expr, clean_name, table_kind

__all__ = [
    "band",
    "calendar_columns",
    "clean_columns",
    "clean_expr",
    "clean_name",
    "date_key",
    "days_label",
    "growth_pct",
    "guarded_ratio",
    "mean",
    "money_label",
    "percent",
    "percent_label",
    "ratio",
    "table_kind",
    "total",
]
