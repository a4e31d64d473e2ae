"""Subscriptions: first snapshot in a window, one-off changes, and the two combined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.functions import zone_extended, zone_simple

SUBSCRIPTION = ["country", "fk_subscription"]


WEEK_LOOKUP = ["calendar_date", "delivery_week"]
CODE_LOOKUP = ["entity_code"]


def week_lookup(calendar: DataFrame) -> DataFrame:
    """One row per date and week. A table with just these columns is one already."""
    return calendar if calendar.columns == WEEK_LOOKUP else calendar.select(*WEEK_LOOKUP).distinct()


def code_lookup(entities: DataFrame) -> DataFrame:
    """One row per entity code. A table with just this column is one already."""
    return entities if entities.columns == CODE_LOOKUP else entities.select(*CODE_LOOKUP).distinct()


def with_week(df: DataFrame, calendar: DataFrame, date_column: str = "delivery_wk_4") -> DataFrame:
    """Delivery week of a date column; NULL for dates the calendar does not have."""
    weeks = week_lookup(calendar).withColumnRenamed("calendar_date", date_column)
    return df.join(weeks, date_column, "left")


def weeks_between(calendar: DataFrame, dates: tuple[str, str]) -> DataFrame:
    """Delivery weeks that planned dates of a range fall in."""
    return calendar.filter(F.col("calendar_date").between(*dates)).select("delivery_week").distinct()


def in_week_of(df: DataFrame, calendar: DataFrame, day: str, date: str = "delivery_wk_4") -> DataFrame:
    """Rows planned for the day, or for the week the calendar gives it."""
    week = calendar.filter(F.col("calendar_date") == day).agg(F.min("delivery_week"))
    return df.filter((F.col(date) == day) | (F.col("delivery_week") == week.scalar()))


def one_off_changes(
    changes: DataFrame,
    calendar: DataFrame,
    units: Sequence[str],
    min_week: str,
    dedupe: bool = True,
    weeks: DataFrame | None = None,
) -> DataFrame:
    """One-off delivery changes, their (week, weekday) turned into a date.

    The change table counts weekdays from Monday = 1, the calendar from Monday = 0. ``weeks``
    (with a ``delivery_week`` column) limits the changes to weeks a later override can use.
    """
    picked = changes.filter(
        F.col("business_unit").isin(*units)
        & (F.col("week_id") >= min_week)
        & F.col("delivery_time").isNotNull()
    )
    if weeks is not None:
        wanted = weeks.select(F.col("delivery_week").alias("week_id"))
        picked = picked.join(wanted, "week_id", "left_semi")
    days = calendar.select(
        F.col("delivery_week").alias("week_id"),
        (F.col("day_of_week") + 1).alias("delivery_weekday"),
        "day_name",
        "calendar_date",
    )
    dated = picked.join(days, ["week_id", "delivery_weekday"], "left").select(
        "business_unit",
        "fk_subscription",
        F.col("delivery_weekday").alias("changed_delivery_weekday"),
        "day_name",
        F.col("delivery_time").alias("changed_delivery_time"),
        F.col("calendar_date").alias("changed_delivery_date"),
        F.col("week_id").alias("delivery_week"),
    )
    return dated.distinct() if dedupe else dated


def snapshot_window(
    snapshots: DataFrame,
    units: Sequence[str],
    import_range: tuple[int, int],
    delivery_range: tuple[str, str],
) -> DataFrame:
    """Snapshots of the units taken in a window, for planned deliveries in another."""
    return snapshots.filter(
        F.col("fk_imported_at_date").between(*import_range)
        & F.col("country").isin(*units)
        & F.col("delivery_wk_4").between(*delivery_range)
    )


def first_snapshot(
    snapshots: DataFrame,
    units: Sequence[str],
    import_range: tuple[int, int],
    delivery_range: tuple[str, str],
) -> DataFrame:
    """Earliest snapshot per subscription in the window.

    Rows of the same day are told apart by planned date, then time, then postcode. Each map task
    keeps its own first row per subscription before the shuffle.
    """
    order = Window.partitionBy(*SUBSCRIPTION).orderBy(
        "fk_imported_at_date", "delivery_wk_4", "delivery_time", "zip"
    )
    return (
        snapshot_window(snapshots, units, import_range, delivery_range)
        .select(*SUBSCRIPTION, "fk_imported_at_date", "delivery_wk_4", "delivery_time", "zip")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") == 1)
        .drop("place")
    )


def with_simple_zone(df: DataFrame, min_length: int = 0, fix_nl: bool = False) -> DataFrame:
    """Shift zone by the simple rules; rows with a zone shorter than ``min_length`` drop out."""
    zoned = df.withColumn("zone", zone_simple(F.col("country"), F.col("zip"), fix_nl))
    return zoned.filter(F.length("zone") >= min_length) if min_length else zoned


def with_extended_zone(df: DataFrame, entities: DataFrame) -> DataFrame:
    """Shift zone by the extended rules, which look at the entity code (NULL if unknown)."""
    codes = code_lookup(entities)
    return (
        df.join(codes, df["country"] == codes["entity_code"], "left")
        .withColumn("zone", zone_extended(F.col("entity_code"), F.col("zip")))
        .drop("entity_code")
    )


def apply_overrides(base: DataFrame, one_offs: DataFrame) -> DataFrame:
    """Planned deliveries with one-off changes of the same week put in.

    ``base`` carries its ``delivery_week``. Changes are reduced to distinct (time, date) pairs per
    subscription and week before the join; two different changes in one week give two rows.
    """
    changed = one_offs.select(
        F.col("business_unit").alias("country"),
        "fk_subscription",
        "delivery_week",
        "changed_delivery_time",
        "changed_delivery_date",
    ).distinct()
    return base.join(changed, [*SUBSCRIPTION, "delivery_week"], "left").withColumns(
        {
            "updated_delivery_time": F.coalesce("changed_delivery_time", "delivery_time"),
            "updated_delivery_date": F.coalesce("changed_delivery_date", "delivery_wk_4"),
        }
    )


def override_dates(base: DataFrame, one_offs: DataFrame) -> DataFrame:
    """Like ``apply_overrides`` for analyses that move the date only and keep the planned time.

    Where a week holds several changes the earliest date counts, so there is one row per base row.
    """
    changed = one_offs.groupBy(
        F.col("business_unit").alias("country"), "fk_subscription", "delivery_week"
    ).agg(F.min("changed_delivery_date").alias("changed_delivery_date"))
    return base.join(changed, [*SUBSCRIPTION, "delivery_week"], "left").withColumn(
        "updated_delivery_date", F.coalesce("changed_delivery_date", "delivery_wk_4")
    )


def snapshot_dates(snapshots: DataFrame, units: Sequence[str], delivery_date: str) -> DataFrame:
    """Snapshot days that plan a delivery on the given date: helps to choose the base window."""
    return (
        snapshots.filter(
            F.col("country").isin(*units) & (F.col("delivery_wk_4") == delivery_date)
        )
        .select("fk_imported_at_date")
        .distinct()
        .orderBy("fk_imported_at_date")
    )


def delivery_dates(
    snapshots: DataFrame, units: Sequence[str], import_range: tuple[int, int]
) -> DataFrame:
    """Planned delivery dates seen in a snapshot window."""
    return (
        snapshots.filter(
            F.col("country").isin(*units) & F.col("fk_imported_at_date").between(*import_range)
        )
        .select("delivery_wk_4")
        .distinct()
        .orderBy("delivery_wk_4")
    )
