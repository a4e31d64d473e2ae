"""Date expressions. Dates travel as ISO strings or as ``yyyyMMdd`` integers, as in the sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUS_WEEKS = 5
STATUS_OUTSIDE = "Other"


def compact_date(timestamp_text: Column) -> Column:
    """``2024-01-05T08:00:00`` -> ``20240105``."""
    return F.replace(F.substring(timestamp_text, 1, 10), F.lit("-"), F.lit(""))


def day_number(day: dt.date | str) -> int:
    """A calendar day as the ``yyyyMMdd`` integer the snapshot tables carry (plan-time helper)."""
    if isinstance(day, str):
        day = dt.date.fromisoformat(day)
    return day.year * 10_000 + day.month * 100 + day.day


def cutoff_day(delivery_date: Column, cutoff_days: Column) -> Column:
    """Three-letter upper-case weekday on which orders close, ``cutoff_days`` before delivery."""
    closing = F.date_sub(delivery_date, cutoff_days.cast("int"))
    return F.upper(F.date_format(closing, "EEE"))


def holiday_week_status(snapshot_day: Column, start: str) -> Column:
    """Status of the holiday week as seen on a snapshot day.

    Every snapshot row forecasts five weeks (``status_wk_0`` .. ``status_wk_4``). In the first
    seven days from ``start`` the holiday is four weeks out, in the next seven three, and so on;
    days before ``start`` or past the fifth week read ``Other``. The week bounds become integer
    literals here, so no date is parsed per row.
    """
    first = dt.date.fromisoformat(start)
    status = None
    for week in range(STATUS_WEEKS):
        low = first + dt.timedelta(days=7 * week)
        high = low + dt.timedelta(days=6)
        inside = snapshot_day.between(day_number(low), day_number(high))
        forecast = F.col(f"status_wk_{STATUS_WEEKS - 1 - week}")
        status = F.when(inside, forecast) if status is None else status.when(inside, forecast)
    return status.otherwise(F.lit(STATUS_OUTSIDE))
