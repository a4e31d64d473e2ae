from shiftlab.operators.cohorts import (
    OPTION_LETTERS,
    ORDER_LETTERS,
    STATUS_LETTERS,
    assign_cohort,
    cohort_members,
    cohort_members_by_flag,
    cohort_name,
    cohort_sizes,
    match_shifts,
)
from shiftlab.operators.panel import cohort_totals
from tests.helpers import rows

HOLIDAY = "2024-01-29"
SUBSCRIPTION_COLUMNS = (
    "country string, fk_subscription long, zone string, updated_delivery_time string, "
    "updated_delivery_date string"
)
SHIFT_COLUMNS = (
    "business_unit string, postal_code string, origin_option_handle string, origin_date string, "
    "target_date string, target_option_handle string"
)


def matched(spark, **options):
    subscriptions = spark.createDataFrame(
        [
            ("GB", 1, "M1", "a", HOLIDAY),
            ("GB", 2, "M1", "b", HOLIDAY),
            ("GB", 3, "M1", "a", "2024-01-30"),
            ("GB", 4, "M2", "a", HOLIDAY),
            ("FR", 5, "M1", "a", HOLIDAY),
            ("GB", 6, "M3", "a", HOLIDAY),
        ],
        SUBSCRIPTION_COLUMNS,
    )
    shifts = spark.createDataFrame(
        [
            ("GB", "M1", "a", HOLIDAY, "2024-01-28", "x"),
            ("GB", "M1", "a", HOLIDAY, "2024-01-28", "y"),
            ("GB", "M2", "a", HOLIDAY, "2024-01-30", "x"),
            ("GB", "M2", "a", HOLIDAY, "2024-01-31", "x"),
            ("GB", "M3", "a", HOLIDAY, None, "x"),
        ],
        SHIFT_COLUMNS,
    )
    return match_shifts(subscriptions, shifts, **options)


def test_every_subscription_stays_and_unmatched_ones_keep_their_date(spark):
    assert rows(matched(spark), "fk_subscription", "target_date") == [
        (1, "2024-01-28"),
        (2, HOLIDAY),
        (3, "2024-01-30"),
        (4, "2024-01-30"),
        (4, "2024-01-31"),
        (5, HOLIDAY),
        (6, HOLIDAY),
    ]


def test_kept_shift_columns_add_rows(spark):
    kept = matched(spark, keep=["target_option_handle"])
    assert [r for r in rows(kept, "fk_subscription", "target_option_handle") if r[0] < 3] == [
        (1, "x"),
        (1, "y"),
        (2, None),
    ]


def test_match_without_date(spark):
    by_zone = matched(spark, by_date=False)
    assert (3, "2024-01-28") in rows(by_zone, "fk_subscription", "target_date")


def test_labels_and_letters(spark):
    days = {
        -5: None,
        -4: "Cohort H (-4)",
        -3: "Cohort F (-3)",
        -2: "Cohort D (-2)",
        -1: "Cohort B (-1)",
        0: "Cohort A (0)",
        1: "Cohort C (+1)",
        2: "Cohort E (+2)",
        3: "Cohort G (+3)",
        4: None,
    }
    df = spark.sql(
        f"SELECT d, '{HOLIDAY}' AS updated_delivery_date, "
        f"string(date_add(DATE'{HOLIDAY}', d)) AS target_date FROM (SELECT explode(sequence(-5, 4)) AS d)"
    )
    assert dict(rows(assign_cohort(df, HOLIDAY, OPTION_LETTERS), "d", "cohort")) == days
    status = dict(rows(assign_cohort(df, HOLIDAY, STATUS_LETTERS), "d", "cohort"))
    assert status == {**days, -4: None}
    orders = dict(rows(assign_cohort(df, HOLIDAY, ORDER_LETTERS), "d", "cohort"))
    assert (orders[3], orders[-3]) == ("Cohort F (+3)", "Cohort G (-3)")
    assert assign_cohort(df, "2024-01-30", STATUS_LETTERS).count() == 0
    assert cohort_name("A", 0) == "Cohort A (0)"


def test_members_sizes_and_flags(spark):
    labelled = spark.createDataFrame(
        [
            ("GB", 1, "A", None),
            ("GB", 1, "A", None),
            ("GB", 1, "B", True),
            ("GB", 2, "B", True),
            ("GB", 2, "B", False),
            ("GB", 3, None, False),
        ],
        "country string, fk_subscription long, cohort string, flag boolean",
    )
    assert rows(cohort_members(labelled), "fk_subscription", "cohort") == [
        (1, "A"),
        (1, "B"),
        (2, "B"),
        (3, None),
    ]
    assert rows(cohort_sizes(labelled)) == [(None, 1), ("A", 1), ("B", 2)]
    assert (("B", True, 2)) in rows(cohort_sizes(labelled, "flag"))
    assert rows(cohort_members_by_flag(labelled, "flag")) == [
        ("GB", 1, "A", False, False, True),
        ("GB", 1, "B", True, False, False),
        ("GB", 2, "B", True, True, False),
        ("GB", 3, None, False, True, False),
    ]


def test_an_id_in_two_units_is_two_subscriptions(spark):
    df = spark.createDataFrame(
        [("GB", 1, 20240101, "A"), ("FR", 1, 20240101, "A"), ("GB", 1, 20240101, "A")],
        "country string, fk_subscription long, fk_imported_at_date int, cohort string",
    )
    assert rows(cohort_sizes(df)) == [("A", 2)]
    assert rows(cohort_totals(df)) == [(20240101, "A", 2)]
