"""Calendar attributes of a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(col: Column | str) -> Column:
    """yyyymmdd as int. Integer arithmetic: no string is built per row."""
    day = F.col(col).cast("date") if isinstance(col, str) else col.cast("date")
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def calendar_columns(date: str) -> dict[str, Column]:
    """The ten attributes kept for a date. Weeks are ISO, day 1 is Sunday."""
    weekday = F.dayofweek(date)
    return {
        "date_key": date_key(date),
        "year": F.year(date),
        "quarter": F.quarter(date),
        "month": F.month(date),
        "month_name": F.date_format(date, "MMMM"),
        "day": F.dayofmonth(date),
        "day_of_week": weekday,
        "day_name": F.date_format(date, "EEEE"),
        "week_of_year": F.weekofyear(date),
        # a NULL date is not a weekend
        "is_weekend": F.coalesce(weekday.isin(1, 7), F.lit(False)),
    }
