"""Daily status of cohort members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.functions import holiday_week_status
from shiftlab.operators.scale import keep_known
from shiftlab.operators.subscriptions import SUBSCRIPTION


def panel_snapshots(
    snapshots: DataFrame, units: Sequence[str], date_range: tuple[int, int]
) -> DataFrame:
    """Snapshots of the units in the panel's date range."""
    return snapshots.filter(
        F.col("country").isin(*units) & F.col("fk_imported_at_date").between(*date_range)
    )


def daily_panel(
    members: DataFrame, snapshots: DataFrame, units: Sequence[str], date_range: tuple[int, int]
) -> DataFrame:
    """Every member on every snapshot day of the range.

    The distinct days travel as one array (no longer than the range has days) that each member
    row expands, so no join is needed.
    """
    days = panel_snapshots(snapshots, units, date_range).agg(
        F.collect_set("fk_imported_at_date").alias("days")
    )
    return (
        members.select(*SUBSCRIPTION)
        .distinct()
        .withColumn("days", days.scalar())
        .select(*SUBSCRIPTION, F.explode("days").alias("fk_imported_at_date"))
    )


def holiday_week_statuses(
    snapshots: DataFrame, units: Sequence[str], date_range: tuple[int, int], start: str
) -> DataFrame:
    """Status of the holiday week on each snapshot day, for all subscriptions of the units."""
    return panel_snapshots(snapshots, units, date_range).select(
        *SUBSCRIPTION,
        "fk_imported_at_date",
        holiday_week_status(F.col("fk_imported_at_date"), start).alias("status"),
    )


def status_as_of(
    panel: DataFrame,
    snapshots: DataFrame,
    units: Sequence[str],
    date_range: tuple[int, int],
    start: str,
) -> DataFrame:
    """Panel rows that have a snapshot, with their status."""
    statuses = holiday_week_statuses(snapshots, units, date_range, start)
    return panel.join(statuses, [*SUBSCRIPTION, "fk_imported_at_date"])


def attach_cohort(statuses: DataFrame, members: DataFrame) -> DataFrame:
    """Cohort columns of ``members`` next to each status row."""
    return statuses.join(members, SUBSCRIPTION, "left")


def cohort_totals(panel: DataFrame) -> DataFrame:
    """Distinct subscriptions per day and cohort."""
    return panel.groupBy("fk_imported_at_date", "cohort").agg(
        F.count_distinct(*SUBSCRIPTION).alias("total_subs")
    )


def member_days(
    statuses: DataFrame, members: DataFrame, known: DataFrame | None = None
) -> DataFrame:
    """Statuses of the members with their cohort columns, for every day of the panel.

    Stands for panel, status and cohort join together: the panel's days are the days of the
    snapshots themselves, so members x days joined to snapshots is just the members' snapshots.
    With ``known`` (the members, if they fit a broadcast) nothing is shuffled; without it
    duplicates collapse before the join shuffles them. Rows may repeat.
    """
    if known is not None:
        return statuses.join(known, SUBSCRIPTION)
    return statuses.distinct().join(members, SUBSCRIPTION)


def member_statuses(
    statuses: DataFrame, members: DataFrame, known: DataFrame | None = None
) -> DataFrame:
    """Distinct (subscription, cohort, status) over the whole panel, without its days."""
    held = keep_known(statuses, known, SUBSCRIPTION).select(*SUBSCRIPTION, "status").distinct()
    return held.join(members if known is None else known, SUBSCRIPTION)
