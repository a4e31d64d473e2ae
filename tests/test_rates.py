"""Panel and status rates against a plain-Python reading of their definition."""

import random
from collections import defaultdict

import pytest

from shiftlab.operators.cohorts import OPTION_LETTERS, STATUS_LETTERS, cohort_name
from shiftlab.operators.panel import (
    attach_cohort,
    cohort_totals,
    daily_panel,
    member_days,
    member_statuses,
    status_as_of,
)
from shiftlab.operators.rates import FLAG_VALUES, daily_counts, status_rates, status_rates_by_flag
from shiftlab.operators.scale import only_if_fits
from tests.helpers import rows, table

STATUS_COLUMNS = (
    "country string, fk_subscription long, fk_imported_at_date int, status string"
)
NAMES = [cohort_name(letter, days) for days, letter in OPTION_LETTERS.items()] + [None]


def random_panel(seed):
    rng = random.Random(seed)
    statuses = [
        ("GB", sub, day, rng.choice(["running", "paused", "cancelled", None]))
        for sub in range(25)
        for day in range(20240101, 20240105)
        for _ in range(rng.choice([0, 1, 1, 2, 3]))
    ]
    members = {
        ("GB", sub, rng.choice(NAMES)) for sub in range(3, 25) for _ in range(rng.choice([1, 1, 2]))
    }
    return statuses, sorted(members, key=str)


def expected_rates(statuses, members, columns):
    """Distinct members per cell over the cohort's day total; 0 beside any labelled cohort."""
    cohorts = defaultdict(set)
    for _, sub, *rest in members:
        cohorts[sub].add(tuple(rest))
    cells, totals = defaultdict(set), defaultdict(set)
    for _, sub, day, status in statuses:
        for cohort, *flags in cohorts[sub]:
            cells[day, status].add((cohort, *flags, sub))
            totals[day, cohort].add(sub)
    result = {}
    for (day, status), found in cells.items():
        labelled = any(cohort is not None for cohort, *_ in found)
        result[day, status] = tuple(
            (
                len({f[-1] for f in found if test(f)}) / len(totals[day, cohort])
                if totals[day, cohort]
                else 0.0
            )
            if labelled
            else None
            for cohort, test in columns
        )
    return result


def as_dict(df):
    return {(r[0], r[1]): tuple(r[2:]) for r in (tuple(r) for r in df.collect())}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("broadcast", [True, False])
def test_rates_equal_the_definition(spark, seed, broadcast):
    statuses, members = random_panel(seed)
    daily = spark.createDataFrame(statuses, STATUS_COLUMNS)
    cohort = spark.createDataFrame(members, "country string, fk_subscription long, cohort string")
    known = only_if_fits(cohort, 10_000 if broadcast else 1)
    assert (known is not None) == broadcast
    got = as_dict(
        status_rates(daily_counts(member_days(daily, cohort, known)), STATUS_LETTERS, "ABCDE")
    )
    columns = [
        (name, lambda f, name=name: f[0] == name)
        for name in (cohort_name(letter, days) for days, letter in STATUS_LETTERS.items() if letter < "F")
    ]
    assert got == expected_rates(statuses, members, columns)


@pytest.mark.parametrize("seed", range(3))
def test_flag_rates_equal_the_definition(spark, seed):
    rng = random.Random(seed)
    statuses, members = random_panel(seed)
    flagged = sorted(
        {(*m, rng.choice([True, False, None])) for m in members for _ in range(rng.choice([1, 1, 2]))},
        key=str,
    )
    summary = defaultdict(set)
    for *member, flag in flagged:
        summary[tuple(member)].add(flag)
    cohort = spark.createDataFrame(
        [(*m, True in f, False in f, None in f) for m, f in summary.items()],
        "country string, fk_subscription long, cohort string, flag_true boolean, "
        "flag_false boolean, flag_null boolean",
    )
    daily = spark.createDataFrame(statuses, STATUS_COLUMNS)
    counts = daily_counts(member_days(daily, cohort), FLAG_VALUES)
    got = as_dict(status_rates_by_flag(counts, OPTION_LETTERS, "ABCDEFG", "A", ["paused"]))
    columns = []
    for days, letter in OPTION_LETTERS.items():
        if letter != "H":
            name = cohort_name(letter, days)
            true = None if letter == "A" else True
            columns += [
                (name, lambda f, n=name, v=true: f[0] == n and f[1] is v),
                (name, lambda f, n=name: f[0] == n and f[1] is False),
            ]
    expected = expected_rates(statuses, flagged, columns)
    assert got == {key: value for key, value in expected.items() if key[1] == "paused"}


def test_unlabelled_members_alone_give_null_and_unshown_cohorts_give_zero(spark):
    daily = spark.createDataFrame(
        [("GB", 1, 20240101, "running"), ("GB", 2, 20240102, "running")], STATUS_COLUMNS
    )
    cohort = spark.createDataFrame(
        [("GB", 1, None), ("GB", 2, "Cohort G (+3)")],
        "country string, fk_subscription long, cohort string",
    )
    counts = daily_counts(member_days(daily, cohort))
    assert as_dict(status_rates(counts, STATUS_LETTERS, "AB")) == {
        (20240101, "running"): (None, None),
        (20240102, "running"): (0.0, 0.0),
    }


def test_short_form_equals_panel_status_and_cohort_joins(spark):
    snapshots = table(
        spark,
        "status_snapshots",
        [
            {
                "country": country,
                "fk_subscription": sub,
                "fk_imported_at_date": day,
                **{f"status_wk_{k}": f"{sub}-{day}-{k}" for k in range(5)},
            }
            for country, sub, day in [
                ("GB", 1, 20240101),
                ("GB", 1, 20240109),
                ("GB", 2, 20240101),
                ("GB", 3, 20240102),
                ("FR", 4, 20240103),
                ("GB", 1, 20240301),
            ]
        ],
    )
    members = spark.createDataFrame(
        [("GB", 1, "A"), ("GB", 1, "B"), ("GB", 3, None)],
        "country string, fk_subscription long, cohort string",
    )
    args = (["GB"], (20240101, 20240131))
    panel = daily_panel(members, snapshots, *args)
    assert rows(panel, "fk_subscription", "fk_imported_at_date") == [
        (sub, day) for sub in (1, 3) for day in (20240101, 20240102, 20240109)
    ]
    status = status_as_of(panel, snapshots, *args, "2024-01-01")
    assert rows(status, "fk_subscription", "status") == [
        (1, "1-20240101-4"),
        (1, "1-20240109-3"),
        (3, "3-20240102-4"),
    ]
    attached = attach_cohort(status, members)
    assert rows(cohort_totals(attached)) == [
        (20240101, "A", 1),
        (20240101, "B", 1),
        (20240102, None, 1),
        (20240109, "A", 1),
        (20240109, "B", 1),
    ]
    columns = ("fk_subscription", "cohort", "fk_imported_at_date", "status")
    for known in (None, members):
        assert rows(member_days(status, members, known), *columns) == rows(attached, *columns)
    held = member_statuses(status, members)
    assert rows(held, "fk_subscription", "cohort", "status") == rows(
        attached.distinct(), "fk_subscription", "cohort", "status"
    )
