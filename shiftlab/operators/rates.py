"""Daily share of each cohort in each status."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.operators.cohorts import cohort_name
from shiftlab.operators.subscriptions import SUBSCRIPTION

FLAG_VALUES = ("flag_true", "flag_false", "flag_null")


def daily_counts(days: DataFrame, flags: Sequence[str] = ()) -> DataFrame:
    """Members per (day, status, cohort), and the cohort's size that day.

    Each row of ``days`` (see ``member_days``) counts at two levels, its status and the whole
    cohort: a member with two statuses on a day is one member. Both levels are made distinct in
    one hash aggregate that combines before its shuffle; everything past it is days x statuses x
    cohorts rows. Flags belong to (subscription, cohort) and so add no rows.
    """
    day_cohort = ["fk_imported_at_date", "cohort"]
    levels = F.inline(
        F.array(
            F.struct(F.col("status"), F.lit(False).alias("whole")),
            F.struct(F.lit(None).cast("string").alias("status"), F.lit(True).alias("whole")),
        )
    )
    counts = (
        days.select(*day_cohort, *SUBSCRIPTION, *flags, levels)
        .distinct()
        .groupBy(*day_cohort, "status", "whole")
        .agg(
            F.count("*").alias("members"), *[F.count_if(flag).alias(flag) for flag in flags]
        )
    )
    size = F.max(F.when(F.col("whole"), F.col("members"))).over(Window.partitionBy(*day_cohort))
    return counts.withColumn("total_subs", size).filter(~F.col("whole")).drop("whole")


def _wide(counts: DataFrame, shares: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row per (day, status), one column per (cohort, count column).

    A missing cohort reads 0 where the row belongs to any labelled cohort, even one without a
    column, and NULL where only unlabelled members hold that status on that day.
    """
    labelled = F.max(F.col("cohort").isNotNull())

    def share(cohort: str, count: str):
        own = F.max(F.when(F.col("cohort") == cohort, F.col(count) / F.col("total_subs")))
        return F.when(labelled, F.coalesce(own, F.lit(0.0)))

    return counts.groupBy(
        F.col("fk_imported_at_date").alias("Date"), F.col("status").alias("Status")
    ).agg(*[share(*source).alias(column) for column, source in shares.items()])


def status_rates(
    counts: DataFrame, letters: Mapping[int, str], shown: Collection[str]
) -> DataFrame:
    """Share of each shown cohort in each status, one column per cohort."""
    return _wide(
        counts,
        {
            f"Cohort_{letter}": (cohort_name(letter, days), "members")
            for days, letter in letters.items()
            if letter in shown
        },
    )


def status_rates_by_flag(
    counts: DataFrame,
    letters: Mapping[int, str],
    shown: Collection[str],
    null_is_true: Collection[str] = (),
    statuses: Sequence[str] | None = None,
) -> DataFrame:
    """Like ``status_rates`` with two columns per cohort, for members with and without the change.

    Both are shares of the whole cohort. For cohorts in ``null_is_true`` the TRUE column counts
    members whose flag is unknown: an unshifted delivery has no target option to compare with.
    """
    shares = {}
    for days, letter in letters.items():
        if letter in shown:
            name = cohort_name(letter, days)
            true_count = "flag_null" if letter in null_is_true else "flag_true"
            shares[f"Cohort_{letter}_TRUE"] = (name, true_count)
            shares[f"Cohort_{letter}_FALSE"] = (name, "flag_false")
    if statuses is not None:
        counts = counts.filter(F.col("status").isin(*statuses))
    return _wide(counts, shares)
