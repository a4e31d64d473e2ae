"""One registered query per operator and analysis, over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlab_checks.driver_views import DriverViews
from shiftlab import plans
from shiftlab.functions import cutoff_day, zone_extended, zone_simple
from shiftlab.operators import (
    cohorts,
    impact,
    options,
    orders,
    panel,
    rates,
    shifts,
    subscriptions,
)

UNITS = ("BE", "FR", "GB", "IE", "NL")
NATIONS = tuple(f"NATION_{i}" for i in range(25))
HOLIDAY = "2024-01-29"
MIN_WEEK = "2024-W01"
MIN_IMPORT = 20240101

STUDY = plans.HolidayStudy(
    units=UNITS,
    holiday=HOLIDAY,
    import_range=(20240101, 20240107),
    delivery_range=("2024-01-29", "2024-02-02"),
    panel_range=(20240101, 20240130),
    start="2023-12-31",
    min_week=MIN_WEEK,
)
ORDER_STUDY = plans.OrderStudy(
    units=UNITS,
    holiday=HOLIDAY,
    import_range=(20240101, 20240107),
    delivery_range=("2024-01-29", "2024-02-02"),
    panel_range=(20240101, 20240130),
    start="2024-01-03",
    min_week=MIN_WEEK,
    ranges={
        "Pre_10W_AOR": ("2023-W47", "2024-W04"),
        "Pre_5W_AOR": ("2023-W52", "2024-W04"),
        "Post_5W_AOR": ("2024-W05", "2024-W09"),
        "Post_10W_AOR": ("2024-W05", "2024-W14"),
    },
    order_weeks=("2023-W47", "2024-W14"),
    customer_weeks=("2023-W47", "2024-W40"),
)

# Option flag variants: registered name -> (flag, cohorts whose unknown flag counts as TRUE, statuses).
FLAG_VARIANTS = {
    "packing_day": ("packing_day_shifted", "A", ("paused",)),
    "packing_day_strict": ("packing_day_shifted", "", ("paused",)),
    "packing_day_in_every_status": (
        "packing_day_shifted",
        "A",
        ("running", "cancelled", "paused"),
    ),
    "cutoff_day": ("cutoff_day_shifted", "", ("paused",)),
    "cutoff_value": ("cutoff_value_shifted", "", ("paused",)),
    "delivery_time": ("delivery_time_shift", "", ("paused",)),
    "surcharge": ("surcharge_shifted", "", ("paused",)),
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(build: Callable[[DriverViews], DataFrame]) -> Callable:
    """Register a function of the source tables under its own name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(DriverViews(spark, folder))

    QUERIES[build.__name__] = run
    return build


def _active(t, drop_deleted: bool = True) -> DataFrame:
    return shifts.active_shifts(t["shifts"], UNITS, HOLIDAY, drop_deleted)


def _latest(t) -> DataFrame:
    return shifts.active_shifts(t["latest_shifts"], UNITS, HOLIDAY, drop_deleted=False)


def _one_offs(t, dedupe: bool = True) -> DataFrame:
    return subscriptions.one_off_changes(t["changes"], t["calendar"], UNITS, MIN_WEEK, dedupe)


def _first(t) -> DataFrame:
    return subscriptions.first_snapshot(
        t["snapshots"], UNITS, STUDY.import_range, STUDY.delivery_range
    )


def _moved(t) -> DataFrame:
    zoned = subscriptions.with_simple_zone(_first(t))
    return subscriptions.apply_overrides(
        subscriptions.with_week(zoned, t["calendar"]), _one_offs(t)
    )


def _options(t) -> DataFrame:
    return options.delivery_options(
        t["options"], t["entities"], MIN_IMPORT, entity_countries=NATIONS, with_slot=True
    )


def _flagged(t) -> DataFrame:
    return options.option_change_flags(_active(t).drop("published_date").distinct(), _options(t))


def _labelled(t) -> DataFrame:
    return cohorts.assign_cohort(
        cohorts.match_shifts(_moved(t), _active(t)), HOLIDAY, cohorts.STATUS_LETTERS
    )


def _members(t) -> DataFrame:
    return cohorts.cohort_members(_labelled(t))


def _panel(t) -> DataFrame:
    return panel.daily_panel(_members(t), t["status_snapshots"], UNITS, STUDY.panel_range)


def _statuses(t) -> DataFrame:
    return panel.status_as_of(
        _panel(t), t["status_snapshots"], UNITS, STUDY.panel_range, ORDER_STUDY.start
    )


@registered
def active_shifts(t):
    return _active(t)


@registered
def active_shifts_with_deleted(t):
    return _active(t, drop_deleted=False)


@registered
def shift_registry(t):
    return shifts.shift_registry(t["shifts"], t["entities"], t["calendar"], UNITS, "2024")


@registered
def publication_start(t):
    return shifts.publication_start(_active(t))


@registered
def one_off_changes(t):
    return _one_offs(t)


@registered
def one_off_changes_with_repeats(t):
    return _one_offs(t, dedupe=False)


@registered
def first_snapshot(t):
    return _first(t)


def _zones(t, zone) -> DataFrame:
    return (
        t["snapshots"]
        .select("country", "zip")
        .distinct()
        .withColumn("zone", zone(F.col("country"), F.col("zip")))
    )


@registered
def simple_zones(t):
    return _zones(t, zone_simple)


@registered
def simple_zones_fixed_nl(t):
    return _zones(t, lambda country, code: zone_simple(country, code, fix_nl=True))


@registered
def extended_zones(t):
    return _zones(t, zone_extended)


@registered
def applied_overrides(t):
    return _moved(t).distinct()


@registered
def overridden_dates(t):
    base = subscriptions.with_week(_first(t), t["calendar"])
    return subscriptions.override_dates(base, _one_offs(t, dedupe=False))


@registered
def delivery_options_by_region(t):
    return options.delivery_options(t["options"], t["entities"], MIN_IMPORT, regions=UNITS)


@registered
def delivery_options_with_slot(t):
    return _options(t)


@registered
def delivery_outcomes(t):
    return impact.delivery_outcomes(t["order_items"], MIN_WEEK)


@registered
def matched_shifts(t):
    return cohorts.match_shifts(
        _moved(t).select(
            "country", "fk_subscription", "zone", "updated_delivery_time", "updated_delivery_date"
        ),
        _active(t),
        keep=["target_option_handle"],
    ).distinct()


@registered
def matched_shifts_by_planned_time(t):
    zoned = subscriptions.with_extended_zone(
        subscriptions.with_week(_first(t), t["calendar"]), t["entities"]
    )
    moved = subscriptions.override_dates(zoned, _one_offs(t, dedupe=False))
    return cohorts.match_shifts(
        moved.select(
            "country", "fk_subscription", "zone", "delivery_time", "updated_delivery_date"
        ),
        _latest(t),
        by_date=False,
        time="delivery_time",
    )


@registered
def affected_subscriptions(t):
    deliveries = plans.impact_table.shifted_deliveries(
        t,
        shifts.shift_registry(t["shifts"], t["entities"], t["calendar"], UNITS, "2024"),
        UNITS,
        MIN_WEEK,
        "2024-01-01",
    )
    return impact.affected_subscriptions(deliveries)


@registered
def option_change_flags(t):
    return _flagged(t)


@registered
def option_change_flags_with_normalised_slots(t):
    return options.option_change_flags(
        _active(t).drop("published_date").distinct(), _options(t), normalise_slots=True
    )


@registered
def cutoff_days(t):
    return (
        options.with_both_options(_active(t), _options(t), ["cutoff"])
        .select(
            "business_unit",
            "origin_option_handle",
            "origin_date",
            cutoff_day(F.col("origin_date"), F.col("origin_cutoff")).alias("closes"),
        )
        .distinct()
    )


@registered
def status_cohorts(t):
    return (
        _labelled(t).select("country", "fk_subscription", "zone", "day_shift", "cohort").distinct()
    )


@registered
def order_cohorts(t):
    return (
        plans.order_study.order_cohorts(t, ORDER_STUDY)
        .select("country", "fk_subscription", "zone", "day_shift", "cohort")
        .distinct()
    )


@registered
def daily_panel(t):
    return _panel(t)


@registered
def statuses_as_of(t):
    return _statuses(t).distinct()


@registered
def attached_cohorts(t):
    return panel.attach_cohort(_statuses(t), _members(t)).distinct()


@registered
def cohort_totals(t):
    return panel.cohort_totals(panel.attach_cohort(_statuses(t), _members(t)))


@registered
def daily_cohort_counts(t):
    daily = panel.holiday_week_statuses(
        t["status_snapshots"], UNITS, STUDY.panel_range, ORDER_STUDY.start
    )
    return rates.daily_counts(panel.member_days(daily, _members(t)))


@registered
def snapshot_dates(t):
    return subscriptions.snapshot_dates(t["snapshots"], UNITS, HOLIDAY)


@registered
def delivery_dates(t):
    return subscriptions.delivery_dates(t["snapshots"], UNITS, STUDY.import_range)


@registered
def shift_coverage(t):
    return cohorts.shift_coverage(shifts.not_deleted(t["shifts"]))


@registered
def published_dates(t):
    return cohorts.published_dates(_active(t))


@registered
def cohort_sizes(t):
    return cohorts.cohort_sizes(_labelled(t))


@registered
def cohort_sizes_by_delivery_time(t):
    labelled = cohorts.assign_cohort(
        cohorts.match_shifts(_moved(t), _flagged(t), keep=options.FLAGS),
        HOLIDAY,
        cohorts.OPTION_LETTERS,
    )
    return cohorts.cohort_sizes(labelled, "delivery_time_shift")


@registered
def latest_customers(t):
    return orders.latest_customer(t["order_lines"], UNITS, ORDER_STUDY.customer_weeks)


@registered
def cohort_orders(t):
    return orders.cohort_orders(
        _members(t),
        orders.latest_customer(t["order_lines"], UNITS, ORDER_STUDY.customer_weeks),
        t["order_lines"],
        UNITS,
        ORDER_STUDY.order_weeks,
        "Mealboxes",
    )


@registered
def shift_impact_table(t):
    return plans.shift_impact_table(t, UNITS)


@registered
def status_rates(t):
    return plans.holiday_status_rates(t, STUDY)


@registered
def status_rates_all_cohorts(t):
    return plans.holiday_status_rates(t, STUDY, shown="ABCDEFG", min_zone_length=0)


def _register_flag_variant(
    name: str, flag: str, null_is_true: str, statuses: tuple[str, ...]
) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plans.holiday_status_rates_by_option(
            DriverViews(spark, folder),
            STUDY,
            flag,
            null_is_true,
            statuses=statuses,
            entity_countries=NATIONS,
        )

    QUERIES[f"status_rates_by_{name}"] = run


for _name, _variant in FLAG_VARIANTS.items():
    _register_flag_variant(_name, *_variant)


@registered
def order_rates(t):
    return plans.holiday_order_rates(t, ORDER_STUDY)


@registered
def order_rates_per_customer(t):
    return plans.holiday_order_rates(t, ORDER_STUDY, box_counts=True, per_customer=True)


def _comparison_input(t) -> DataFrame:
    by_country = plans.holiday_order_rates(t, ORDER_STUDY, by_country=True)
    return plans.comparison_input(by_country, "Test Monday", HOLIDAY)


@registered
def order_rate_deltas(t):
    return _comparison_input(t).drop("Origin Date")


@registered
def control_report_of_order_rates(t):
    return plans.control_report(_comparison_input(t), order_by=["Origin Date", "cohort"])


def control_report(spark: SparkSession, folder: str) -> DataFrame:
    return plans.control_report(DriverViews(spark, folder).comparison_rows())


QUERIES["control_report"] = control_report
