"""Literal tables and plan inspection for the tests."""

from __future__ import annotations

import datetime as dt

from shiftlab.sources import SCHEMAS


def table(spark, name, rows):
    """A source table from dicts; columns left out are NULL."""
    schema = SCHEMAS[name]
    return spark.createDataFrame(
        [tuple(row.get(field.name) for field in schema) for row in rows], schema
    )


def calendar(spark, first="2024-01-01", days=70):
    start = dt.date.fromisoformat(first)
    rows = []
    for n in range(days):
        day = start + dt.timedelta(days=n)
        year, week, weekday = day.isocalendar()
        rows.append(
            {
                "calendar_date": day.isoformat(),
                "delivery_week": f"{year}-W{week:02d}",
                "day_of_week": weekday - 1,
                "day_name": day.strftime("%A"),
            }
        )
    return table(spark, "calendar", rows)


def rows(df, *columns):
    """Rows as a sorted list of tuples (NULLs first)."""
    picked = df.select(*columns) if columns else df
    return sorted(
        (tuple(r) for r in picked.collect()), key=lambda r: [(v is not None, str(v)) for v in r]
    )


def formatted_plan(df):
    """The physical plan as text, before execution."""
    return df._jdf.queryExecution().executedPlan().toString()


def optimized_plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()
