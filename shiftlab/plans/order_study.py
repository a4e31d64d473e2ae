"""Orders per ordering customer before and after a holiday, per cohort and status."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from shiftlab.operators.cohorts import (
    ORDER_LETTERS,
    assign_cohort,
    cohort_members,
    match_shifts,
)
from shiftlab.operators.orders import SALTS, latest_customer, order_rates, typed_order_lines
from shiftlab.operators.panel import holiday_week_statuses, member_statuses
from shiftlab.operators.scale import dimension, only_if_fits, staged
from shiftlab.operators.shifts import active_shifts
from shiftlab.operators.subscriptions import (
    SUBSCRIPTION,
    first_snapshot,
    in_week_of,
    one_off_changes,
    override_dates,
    weeks_between,
    with_extended_zone,
    with_week,
)
from shiftlab.plans.status_study import HolidayStudy


@dataclass(frozen=True)
class OrderStudy(HolidayStudy):
    """A holiday study with the week ranges of its orders.

    ``ranges`` maps output columns to inclusive week ranges. Orders are read for ``order_weeks``,
    the subscription's customer is looked up over ``customer_weeks``.
    """

    ranges: Mapping[str, tuple[str, str]] | None = None
    order_weeks: tuple[str, str] = ("", "")
    customer_weeks: tuple[str, str] = ("", "")
    item_type: str = "Mealboxes"


def order_cohorts(
    tables: Mapping[str, DataFrame], study: OrderStudy, letters: Mapping[int, str] = ORDER_LETTERS
) -> DataFrame:
    """Subscriptions delivered on the holiday with their cohort.

    Their shifts come from ``latest_shifts``, which has no deletion marks: deleted shifts count.
    One-off changes move the date but not the time, and shifts match on zone and planned time only.
    """
    calendar, entities = dimension(tables["calendar"]), dimension(tables["entities"])
    active = active_shifts(tables["latest_shifts"], study.units, study.holiday, drop_deleted=False)
    base = first_snapshot(
        tables["snapshots"], study.units, study.import_range, study.delivery_range
    )
    one_offs = one_off_changes(
        tables["changes"],
        calendar,
        study.units,
        study.min_week,
        dedupe=False,
        weeks=weeks_between(calendar, (study.holiday, study.holiday)),
    )
    planned = in_week_of(with_week(base, calendar), calendar, study.holiday)
    zoned = with_extended_zone(planned, entities)
    matched = match_shifts(
        override_dates(zoned, one_offs), active, by_date=False, time="delivery_time"
    )
    return assign_cohort(matched, study.holiday, letters)


def holiday_order_rates(
    tables: Mapping[str, DataFrame],
    study: OrderStudy,
    letters: Mapping[int, str] = ORDER_LETTERS,
    by_country: bool = False,
    box_counts: bool = False,
    per_customer: bool = False,
) -> DataFrame:
    """Order rates per cohort and status, optionally per country.

    ``tables`` needs ``latest_shifts``, ``snapshots``, ``changes``, ``calendar``, ``entities`` and
    ``order_lines``. Members, then members with status and customer are staged. The order lines are
    read twice: for the members' customers, and for their orders. ``box_counts`` adds the order
    lines of every range, ``per_customer`` divides by all customers of the group instead of those
    who ordered in the range.
    """
    members = staged(cohort_members(order_cohorts(tables, study, letters)), "order-members")
    known = only_if_fits(members)
    statuses = holiday_week_statuses(
        tables["snapshots"], study.units, study.panel_range, study.start
    )
    customers = latest_customer(
        tables["order_lines"], study.units, study.customer_weeks, known=known
    )
    panel = staged(
        member_statuses(statuses, members, known).join(customers, SUBSCRIPTION, "left"), "order-panel"
    )
    lines = typed_order_lines(
        tables["order_lines"], study.units, study.order_weeks, study.item_type, known=known
    )
    by = ["country"] if by_country else []
    salts = 1 if known is not None else SALTS
    rates = order_rates(panel, lines, study.ranges, by, box_counts, per_customer, salts)
    return rates.withColumnsRenamed(
        {"country": "Country", "cohort": "Cohort", "status": "Status"}
    ).orderBy(*(["Country"] if by_country else []), "Cohort", "Status")
