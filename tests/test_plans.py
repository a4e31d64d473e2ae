"""Shapes the plans must keep: pushed filters, narrow scans, few shuffles, no cartesian joins."""

import re

import pytest

from shiftlab_checks.queries import QUERIES
from shiftlab import plans
from shiftlab.operators.orders import latest_customer, typed_order_lines
from shiftlab.operators.panel import holiday_week_statuses, member_days
from shiftlab.operators.rates import daily_counts
from shiftlab.operators.scale import dimension, fits, keep_known, only_if_fits, staged, table_bytes
from shiftlab.operators.shifts import active_shifts
from shiftlab.operators.subscriptions import first_snapshot, with_week
from tests.helpers import calendar, formatted_plan, optimized_plan, table
from tests.test_impact import source_tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Source tables as Parquet, so scans show what reaches them."""
    folder = tmp_path_factory.mktemp("tables")
    tables = {**source_tables(spark), "order_lines": table(spark, "order_lines", [])}
    read = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        read[name] = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    return read


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", formatted_plan(df)))


def scan(df, column):
    lines = [line for line in formatted_plan(df).splitlines() if "FileScan" in line and column in line]
    assert lines, f"no scan with {column}"
    return lines[0]


def test_first_snapshot_filters_in_the_scan_and_keeps_one_row_before_the_shuffle(stored):
    df = first_snapshot(
        stored["snapshots"], ["GB"], (20240101, 20240107), ("2024-01-29", "2024-02-02")
    )
    text = scan(df, "fk_imported_at_date")
    for pushed in ("GreaterThanOrEqual(fk_imported_at_date", "EqualTo(country,GB)", "delivery_wk_4,2024-02-02"):
        assert pushed in text
    assert "status_wk" not in text
    assert exchanges(df) == 1
    assert formatted_plan(df).count("WindowGroupLimit") == 2


def test_shift_and_order_scans_are_narrow(stored):
    active = active_shifts(stored["shifts"], ["GB"], "2024-01-29")
    text = scan(active, "origin_date")
    assert "EqualTo(origin_date,2024-01-29)" in text and "shift_id" not in text
    customers = latest_customer(stored["order_lines"], ["GB"], ("2024-W01", "2024-W10"))
    text = scan(customers, "customer_uuid")
    assert "delivery_week,2024-W10" in text and "order_line_items_id" not in text
    lines = typed_order_lines(stored["order_lines"], ["GB"], ("2024-W01", "2024-W10"), "Mealboxes")
    assert exchanges(lines) == 0 and "EqualTo(order_item_type,Mealboxes)" in scan(lines, "delivery_week")


def members_of(spark, count=10):
    return staged(
        spark.range(count).selectExpr("'GB' AS country", "id AS fk_subscription", "'A' AS cohort"),
        "members",
    )


def test_daily_rates_shuffle_the_snapshots_once(spark, stored):
    members = members_of(spark)
    daily = holiday_week_statuses(
        stored["snapshots"], ["GB"], (20240101, 20240130), "2024-01-01"
    )
    counts = daily_counts(member_days(daily, members, only_if_fits(members)))
    text = formatted_plan(counts)
    assert "ObjectHash" not in text and "SortAggregate" not in text and "Cartesian" not in text and "NestedLoop" not in text
    assert text.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in text
    # distinct members per day; then the small cohort counts twice
    assert exchanges(counts) == 3
    assert "delivery_time" not in scan(counts, "status_wk_4")


def test_beyond_the_bound_nothing_is_broadcast_by_force(spark):
    members = members_of(spark)
    size = table_bytes(members)
    assert size > 10 * len("GB0A") and fits(members, size) and not fits(members, size - 1)
    assert only_if_fits(members, size - 1) is None
    assert "ResolvedHint" not in dimension(members, size - 1)._jdf.queryExecution().analyzed().toString()
    assert keep_known(members, None, ["country"]) is members


def test_marked_calendar_is_broadcast_in_every_lookup(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = with_week(stored["snapshots"], dimension(calendar(spark)))
        assert "BroadcastHashJoin" in formatted_plan(marked)
        plain = with_week(stored["snapshots"], calendar(spark))
        assert "SortMergeJoin" in formatted_plan(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    "name", ["status_rates", "order_rates", "shift_impact_table", "daily_panel", "control_report"]
)
def test_no_plan_has_a_cross_join(spark, name):
    text = formatted_plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_impact_table_reads_few_order_item_columns_and_no_python(stored):
    impact = plans.shift_impact_table(stored, ["GB"])
    text = formatted_plan(impact)
    assert "Python" not in text and "Pandas" not in text
    assert "subscription_nk" in scan(impact, "is_mealbox")
    assert "Expand" not in optimized_plan(impact)


@pytest.mark.parametrize("broadcast", [True, False])
def test_impact_table_filters_by_zone_and_week_and_shuffles_each_table_once(stored, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(plans.impact_table, "dimension", lambda df, *_: df)
        monkeypatch.setattr(plans.impact_table, "staged_dimension", lambda df, name, *_: staged(df, name))
    text = formatted_plan(plans.shift_impact_table(stored, ["GB"]))
    assert "zone_week" in text and "LeftSemi" in text
    if broadcast:
        assert text.count("Exchange hashpartitioning") <= 12
    # Plans and changes: one clustering each, which their join keeps. Nothing falls back to sorting.
    assert text.count("REPARTITION_BY_COL") == 2
    assert "ObjectHash" not in text and "SortAggregate" not in text


def test_unknown_flag_is_refused(spark):
    with pytest.raises(ValueError, match="unknown option flag"):
        plans.holiday_status_rates_by_option({}, None, "colour")
