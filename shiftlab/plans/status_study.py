"""Daily status rates per cohort, plain and split by a changed delivery option."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from shiftlab.operators.cohorts import (
    OPTION_LETTERS,
    STATUS_LETTERS,
    assign_cohort,
    cohort_members,
    cohort_members_by_flag,
    match_shifts,
)
from shiftlab.operators.options import FLAGS, delivery_options, option_change_flags
from shiftlab.operators.panel import holiday_week_statuses, member_days
from shiftlab.operators.rates import (
    FLAG_VALUES,
    daily_counts,
    status_rates,
    status_rates_by_flag,
)
from shiftlab.operators.scale import dimension, only_if_fits, staged
from shiftlab.operators.shifts import active_shifts, with_publication_start
from shiftlab.operators.subscriptions import (
    apply_overrides,
    first_snapshot,
    in_week_of,
    one_off_changes,
    weeks_between,
    with_simple_zone,
    with_week,
)


@dataclass(frozen=True)
class HolidayStudy:
    """What to study: units, holiday, and the windows around it.

    ``import_range`` and ``panel_range`` are inclusive ``yyyyMMdd`` integers, ``delivery_range``
    and ``start`` ISO dates; ``start`` is the first day whose snapshots see the holiday four weeks
    out, normally the first day of ``import_range``.
    """

    units: tuple[str, ...]
    holiday: str
    import_range: tuple[int, int]
    delivery_range: tuple[str, str]
    panel_range: tuple[int, int]
    start: str
    min_week: str = "2024-W01"


def holiday_subscriptions(
    snapshots: DataFrame,
    changes: DataFrame,
    calendar: DataFrame,
    study: HolidayStudy,
    min_zone_length: int = 0,
    fix_nl: bool = False,
) -> DataFrame:
    """First snapshots of the base window that can land on the holiday, with zone and one-off changes.

    A one-off change stays within its week, so plans of other weeks are left out before the join.
    """
    base = first_snapshot(
        snapshots, study.units, study.import_range, study.delivery_range
    )
    one_offs = one_off_changes(
        changes,
        calendar,
        study.units,
        study.min_week,
        dedupe=False,
        weeks=weeks_between(calendar, (study.holiday, study.holiday)),
    )
    zoned = with_simple_zone(base, min_zone_length, fix_nl)
    return apply_overrides(in_week_of(with_week(zoned, calendar), calendar, study.holiday), one_offs)


def holiday_status_rates(
    tables: Mapping[str, DataFrame],
    study: HolidayStudy,
    letters: Mapping[int, str] = STATUS_LETTERS,
    shown: Collection[str] = "ABCDE",
    min_zone_length: int = 3,
    fix_nl: bool = False,
) -> DataFrame:
    """Share of each cohort per day and status of the holiday week.

    ``tables`` needs ``shifts``, ``snapshots``, ``status_snapshots``, ``changes``, ``calendar``.
    """
    active = staged(active_shifts(tables["shifts"], study.units, study.holiday), "active-shifts")
    subscriptions = holiday_subscriptions(
        tables["snapshots"],
        tables["changes"],
        dimension(tables["calendar"]),
        study,
        min_zone_length,
        fix_nl,
    )
    labelled = assign_cohort(match_shifts(subscriptions, active), study.holiday, letters)
    members = staged(cohort_members(labelled), "cohort-members")
    statuses = holiday_week_statuses(
        tables["status_snapshots"], study.units, study.panel_range, study.start
    )
    days = member_days(statuses, members, known=only_if_fits(members))
    rates = status_rates(daily_counts(days), letters, shown)
    return with_publication_start(rates, active).orderBy("Date", "Status")


def holiday_status_rates_by_option(
    tables: Mapping[str, DataFrame],
    study: HolidayStudy,
    flag: str = "packing_day_shifted",
    null_is_true: Collection[str] | None = None,
    statuses: Sequence[str] | None = ("paused",),
    entity_countries: Sequence[str] | None = None,
    min_import: int = 20240101,
    letters: Mapping[int, str] = OPTION_LETTERS,
    shown: Collection[str] = "ABCDEFG",
    fix_nl: bool = False,
    normalise_slots: bool = False,
) -> DataFrame:
    """Status rates with each cohort split by whether an option attribute changed with the shift.

    ``flag`` is one of ``FLAGS``. ``tables`` needs ``options`` and ``entities`` besides those of
    ``holiday_status_rates``. Options are limited to ``entity_countries``, by default the units.
    In the cohorts of ``null_is_true`` an unknown flag counts as changed; by default that is the
    unshifted cohort A for the packing day, and none for the other flags.
    """
    if flag not in FLAGS:
        raise ValueError(f"unknown option flag {flag!r}, expected one of {FLAGS}")
    if null_is_true is None:
        null_is_true = "A" if flag == "packing_day_shifted" else ""
    active = staged(active_shifts(tables["shifts"], study.units, study.holiday), "active-shifts")
    options = delivery_options(
        tables["options"],
        dimension(tables["entities"]),
        min_import,
        entity_countries=study.units if entity_countries is None else entity_countries,
        with_slot=True,
    )
    flagged = option_change_flags(active.drop("published_date").distinct(), options, normalise_slots)
    subscriptions = holiday_subscriptions(
        tables["snapshots"], tables["changes"], dimension(tables["calendar"]), study, fix_nl=fix_nl
    )
    labelled = assign_cohort(
        match_shifts(subscriptions, flagged, keep=[flag]), study.holiday, letters
    )
    members = staged(cohort_members_by_flag(labelled, flag), "cohort-members")
    daily = holiday_week_statuses(
        tables["status_snapshots"], study.units, study.panel_range, study.start
    )
    days = member_days(daily, members, known=only_if_fits(members))
    counts = daily_counts(days, FLAG_VALUES)
    rates = status_rates_by_flag(counts, letters, shown, null_is_true, statuses)
    return with_publication_start(rates, active).orderBy("Date", "Status")
