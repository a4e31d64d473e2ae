"""The status and order analyses end to end, on six subscriptions worked out by hand.

Subscription 1 is moved a day later. 2 has no shift. The shift of 3 is deleted. 4 changed its Tuesday
to the holiday and its time to one without a shift. 5 changed away from the holiday. 6 is moved four
days earlier.
"""

import pytest

from shiftlab import plans
from tests.helpers import calendar, rows, table
from tests.test_options import option
from tests.test_shifts import shift
from tests.test_subscriptions import change, snap

HOLIDAY = "2024-01-29"
WINDOWS = {
    "units": ("FR",),
    "holiday": HOLIDAY,
    "import_range": (20240101, 20240107),
    "delivery_range": ("2024-01-29", "2024-02-02"),
    "panel_range": (20240101, 20240228),
    "start": "2024-01-01",
}


def seen(sub, day, week, status, planned=HOLIDAY):
    row = snap(sub, day, planned, "a", f"7500{sub}" if sub != 4 else "75001", "FR")
    return {**row, f"status_wk_{week}": status}


@pytest.fixture(scope="module")
def tables(spark):
    snapshots = table(
        spark,
        "snapshots",
        [
            seen(1, 20240101, 4, "running"),
            seen(2, 20240101, 4, "running"),
            seen(3, 20240101, 4, "paused"),
            seen(4, 20240101, 4, "paused", "2024-01-30"),
            seen(5, 20240101, 4, "running"),
            seen(6, 20240101, 4, "cancelled"),
            seen(1, 20240110, 3, "paused"),
            seen(2, 20240110, 3, "running"),
            seen(1, 20240210, 0, "running"),
            seen(1, 20240110, 3, "paused"),
        ],
    )
    french = {"business_unit": "FR", "origin_option_handle": "a", "target_option_handle": "c"}
    moved = [
        shift(**french, postal_code="75001", target_date="2024-01-30"),
        shift(**french, postal_code="75003", meta=("d",)),
        shift(
            **french,
            postal_code="75006",
            target_date="2024-01-25",
            published_time="2024-01-02T08:00:00",
        ),
    ]
    return {
        "calendar": calendar(spark),
        "entities": table(
            spark, "entities", [{"country_group": "EU", "country": "FR", "entity_code": "FR"}]
        ),
        "snapshots": snapshots,
        "status_snapshots": snapshots,
        "shifts": table(spark, "shifts", moved),
        "latest_shifts": table(spark, "latest_shifts", moved),
        "changes": table(
            spark, "changes", [change(4, 1, "b", unit="FR"), change(5, 3, "a", unit="FR")]
        ),
        "options": table(
            spark,
            "options",
            [option("a", region_code="FR"), option("c", region_code="FR", packing_day="TUESDAY")],
        ),
        "order_lines": table(
            spark,
            "order_lines",
            [
                {
                    "subscription_id": sub,
                    "customer_uuid": f"c{sub}",
                    "create_date": "2024-01-01",
                    "order_line_items_id": number,
                    "entity_code": "FR",
                    "delivery_week": week,
                    "order_item_type": kind,
                }
                for sub, number, week, kind in [
                    (1, 1, "2024-W04", "Mealboxes"),
                    (1, 2, "2024-W04", "Mealboxes"),
                    (1, 3, "2024-W05", "Mealboxes"),
                    (1, 3, "2024-W05", "Mealboxes"),
                    (1, 9, "2024-W05", "Addons"),
                    (3, 4, "2024-W05", "Mealboxes"),
                    (2, 5, "2024-W04", "Mealboxes"),
                    (5, 6, "2024-W04", "Mealboxes"),
                    (2, 7, "2024-W20", "Mealboxes"),
                ]
            ],
        ),
    }


def test_status_rates(tables):
    rates = plans.holiday_status_rates(tables, plans.HolidayStudy(**WINDOWS))
    first = "20240102"
    assert rows(rates, "Date", "Status", "Cohort_A", "Cohort_B", "Cohort_C", "publication_date") == [
        (20240101, "cancelled", None, None, None, first),
        (20240101, "paused", 2 / 3, 0.0, 0.0, first),
        (20240101, "running", 1 / 3, 0.0, 1.0, first),
        (20240110, "paused", 0.0, 0.0, 1.0, first),
        (20240110, "running", 1.0, 0.0, 0.0, first),
        (20240210, "Other", 0.0, 0.0, 1.0, first),
    ]
    assert rates.columns == [
        "Date",
        "Status",
        *[f"Cohort_{letter}" for letter in "ABCDE"],
        "publication_date",
    ]
    assert [r[0] for r in rates.collect()] == sorted(r[0] for r in rates.collect())


def test_status_rates_by_packing_day(tables):
    rates = plans.holiday_status_rates_by_option(
        tables, plans.HolidayStudy(**WINDOWS), null_is_true="A", statuses=None
    )
    columns = ("Cohort_A_TRUE", "Cohort_A_FALSE", "Cohort_C_TRUE", "Cohort_C_FALSE")
    assert rows(rates.filter("Date = 20240101"), "Status", *columns) == [
        ("cancelled", 0.0, 0.0, 0.0, 0.0),
        ("paused", 2 / 3, 0.0, 0.0, 0.0),
        ("running", 1 / 3, 0.0, 1.0, 0.0),
    ]
    assert len(rates.columns) == 2 + 14 + 1
    strict = plans.holiday_status_rates_by_option(
        tables, plans.HolidayStudy(**WINDOWS), null_is_true=""
    )
    assert rows(strict, "Date", "Status", "Cohort_A_TRUE", "Cohort_C_TRUE") == [
        (20240101, "paused", 0.0, 0.0),
        (20240110, "paused", 0.0, 1.0),
    ]


def test_order_rates(tables):
    study = plans.OrderStudy(
        **WINDOWS,
        ranges={"Pre": ("2024-W01", "2024-W04"), "Post": ("2024-W05", "2024-W08")},
        order_weeks=("2024-W01", "2024-W08"),
        customer_weeks=("2024-W01", "2024-W30"),
    )
    expected = [
        (None, "cancelled", 0, None, None),
        ("Cohort A (0)", "running", 1, 1.0, None),
        ("Cohort C (+1)", "Other", 1, 2.0, 1.0),
        ("Cohort C (+1)", "paused", 2, 2.0, 1.0),
        ("Cohort C (+1)", "running", 1, 2.0, 1.0),
    ]
    rates = plans.holiday_order_rates(tables, study)
    assert rows(rates) == expected
    by_country = plans.holiday_order_rates(tables, study, by_country=True)
    assert rows(by_country.drop("Country")) == expected


def test_orders_become_a_control_report(tables):
    spans = {
        f"{side}_{span}_AOR": weeks
        for side, weeks in (("Pre", ("2024-W01", "2024-W04")), ("Post", ("2024-W05", "2024-W20")))
        for span in ("5W", "10W")
    }
    study = plans.OrderStudy(
        **WINDOWS,
        ranges=spans,
        order_weeks=("2024-W01", "2024-W20"),
        customer_weeks=("2024-W01", "2024-W30"),
    )
    rates = plans.holiday_order_rates(tables, study, by_country=True)
    lines = plans.comparison_input(rates, "Monday off", HOLIDAY)
    assert rows(lines, "Country", "Holiday", "cohort", "Pre_5W", "Post_5W", "Delta_5W") == [
        ("FR", "Monday off", "Cohort A (0)", 1.0, 1.0, 0.0),
        ("FR", "Monday off", "Cohort C (+1)", 2.0, 1.0, 1.0),
    ]
    report = plans.control_report(lines, order_by=["Origin Date", "cohort"])
    assert rows(report) == [("Delta_10W", 1, 1, 100.0), ("Delta_5W", 1, 1, 100.0)]
