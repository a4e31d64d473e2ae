"""From subscriptions and shifts to cohorts by number of days moved."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlab.operators.subscriptions import SUBSCRIPTION

# Cohort letter per day distance. The two analyses swap the letters of +3 and -3.
STATUS_LETTERS = {0: "A", -1: "B", 1: "C", -2: "D", 2: "E", -3: "F", 3: "G"}
OPTION_LETTERS = {**STATUS_LETTERS, -4: "H"}
ORDER_LETTERS = {0: "A", -1: "B", 1: "C", -2: "D", 2: "E", 3: "F", -3: "G"}


def cohort_name(letter: str, days: int) -> str:
    """``Cohort A (0)``, ``Cohort B (-1)``, ``Cohort C (+1)`` ..."""
    return f"Cohort {letter} ({days:+d})" if days else f"Cohort {letter} (0)"


def match_shifts(
    subscriptions: DataFrame,
    shifts: DataFrame,
    keep: Sequence[str] = (),
    by_date: bool = True,
    time: str = "updated_delivery_time",
    date: str = "updated_delivery_date",
) -> DataFrame:
    """Every subscription, with the target date of its shift or else its own date.

    Shifts match on unit, zone and delivery time, and on the date unless ``by_date`` is off. They
    are first reduced to the distinct values asked for, so a subscription gets one row per target
    date (and per combination of the ``keep`` columns), not one per published row.
    """
    key = {
        "business_unit": "country",
        "postal_code": "zone",
        "origin_option_handle": time,
    }
    if by_date:
        key["origin_date"] = date
    targets = shifts.select(
        *[F.col(source).alias(name) for source, name in key.items()],
        F.col("target_date").alias("shift_target_date"),
        *keep,
    ).distinct()
    return (
        subscriptions.join(targets, list(key.values()), "left")
        .withColumn("target_date", F.coalesce("shift_target_date", date))
        .drop("shift_target_date")
    )


def cohort_label(day_shift: Column, letters: Mapping[int, str]) -> Column:
    """Cohort name for a day distance; NULL for a distance without a letter."""
    label = None
    for days, letter in letters.items():
        name = F.lit(cohort_name(letter, days))
        label = (
            F.when(day_shift == days, name)
            if label is None
            else label.when(day_shift == days, name)
        )
    return label


def assign_cohort(
    matched: DataFrame,
    holiday: str,
    letters: Mapping[int, str],
    original: str = "updated_delivery_date",
    new: str = "target_date",
) -> DataFrame:
    """Cohort of every row whose original date is the holiday, by days between old and new date."""
    return (
        matched.filter(F.col(original) == holiday)
        .withColumn("day_shift", F.datediff(new, original))
        .withColumn("cohort", cohort_label(F.col("day_shift"), letters))
    )


def cohort_members(labelled: DataFrame) -> DataFrame:
    """Distinct (subscription, cohort) pairs."""
    return labelled.select(*SUBSCRIPTION, "cohort").distinct()


def cohort_members_by_flag(labelled: DataFrame, flag: str) -> DataFrame:
    """One row per (subscription, cohort) with the values its option flag takes.

    A subscription may carry several: its handle can have several option versions.
    """
    value = F.col(flag)
    return labelled.groupBy(*SUBSCRIPTION, "cohort").agg(
        F.max(F.coalesce(value, F.lit(False))).alias("flag_true"),
        F.max(F.coalesce(~value, F.lit(False))).alias("flag_false"),
        F.max(value.isNull()).alias("flag_null"),
    )


def shift_coverage(shifts: DataFrame) -> DataFrame:
    """Distinct postcodes with a shift, per origin date."""
    return shifts.groupBy("origin_date").agg(
        F.count_distinct("postal_code").alias("postal_codes")
    )


def cohort_sizes(labelled: DataFrame, flag: str | None = None) -> DataFrame:
    """Distinct subscriptions per cohort, optionally per value of an option flag."""
    keys = ["cohort"] if flag is None else ["cohort", flag]
    return labelled.groupBy(*keys).agg(
        F.count_distinct(*SUBSCRIPTION).alias("subscriptions")
    )


def published_dates(active: DataFrame) -> DataFrame:
    """The days on which shifts of the holiday were published."""
    return active.select("published_date").distinct().orderBy("published_date")
