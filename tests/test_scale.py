"""Staging, and equal results with and without broadcasts on skewed tables."""

import dataclasses
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shiftlab_checks.driver_views import DriverViews
from shiftlab_checks.queries import NATIONS, ORDER_STUDY, STUDY, UNITS
from shiftlab import plans
from shiftlab.operators import scale
from shiftlab.operators.compare import control_comparison
from shiftlab.operators.orders import SALTS, order_rates
from shiftlab.operators.scale import staged, staged_dimension, table_bytes, together
from shiftlab.operators.shifts import active_shifts
from shiftlab.sources import read_sources
from tests.helpers import formatted_plan, rows

SMALL = "/root/testdata/sf0.001"


def repeated(df, condition):
    """``df`` with fifty more copies of the rows that meet the condition."""
    copies = df.filter(condition).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50))))
    return df.union(copies.drop("copy"))


class Skewed(dict):
    """Driver tables in which one subscription holds a large part of all rows."""

    def __init__(self, spark):
        views = DriverViews(spark, SMALL)
        super().__init__({name: views[name] for name in views})
        self["snapshots"] = repeated(self["snapshots"], "fk_subscription = 6")
        self["status_snapshots"] = self["snapshots"]
        self["order_lines"] = repeated(self["order_lines"], "subscription_id = 6")


JOBS = {
    "status": lambda t: plans.holiday_status_rates(t, STUDY, min_zone_length=0),
    "option": lambda t: plans.holiday_status_rates_by_option(
        t, STUDY, statuses=None, entity_countries=NATIONS
    ),
    "orders": lambda t: plans.holiday_order_rates(t, ORDER_STUDY),
    "impact": lambda t: plans.shift_impact_table(t, UNITS),
}


@pytest.mark.parametrize("name", JOBS)
def test_repeats_and_missing_broadcasts_change_nothing(spark, monkeypatch, name):
    views = DriverViews(spark, SMALL)
    expected = rows(JOBS[name](views))
    assert rows(JOBS[name](Skewed(spark))) == expected
    for module in (plans.status_study, plans.order_study, plans.impact_table):
        monkeypatch.setattr(module, "dimension", lambda df, *_: df)
    for module in (plans.status_study, plans.order_study):
        monkeypatch.setattr(module, "only_if_fits", lambda df, *_: None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(JOBS[name](Skewed(spark))) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_skewed_groups_compare_equally(spark):
    df = spark.range(30_000).selectExpr(
        "int(id) AS ordinal",
        "if(id % 3 = 0, 'hot', string(id % 500)) AS Country",
        "'x' AS Holiday",
        "if(id % 1000 < 3, 'Cohort A (0)', 'Cohort B (-1)') AS cohort",
        "double(id % 97) AS delta",
    )
    got = rows(control_comparison(df, ["delta"], ["ordinal"]))
    first, wins, total = {}, 0, 0
    data = [tuple(r) for r in df.orderBy("ordinal").collect()]
    for _, country, _, cohort, delta in data:
        if cohort.startswith("Cohort A"):
            first.setdefault(country, delta)
    for _, country, _, cohort, delta in data:
        if not cohort.startswith("Cohort A") and country in first:
            total += 1
            wins += first[country] <= delta
    assert got[0][:3] == ("delta", wins, total)


def test_staged_tables_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert scale.staging_folder(spark) == folder
    table = scale.staged(spark.range(3), "numbers")
    assert all(file.startswith(f"file://{folder}/numbers-") for file in table.inputFiles())
    assert rows(table) == [(0,), (1,), (2,)]


def test_studies_are_values():
    other = dataclasses.replace(STUDY, units=("GB",))
    assert other.units == ("GB",) and other.holiday == STUDY.holiday


def test_impact_table_with_too_many_shift_keys_to_broadcast(spark, monkeypatch):
    views = DriverViews(spark, SMALL)
    expected = rows(plans.shift_impact_table(views, UNITS))
    monkeypatch.setattr(plans.impact_table, "dimension", lambda df, *_: df)
    assert rows(plans.shift_impact_table(views, UNITS)) == expected


def test_staged_tables_are_deleted_at_the_end(spark, tmp_path):
    before = set(Path(scale.staging_folder(spark)).iterdir())
    with scale.staging(spark):
        views = DriverViews(spark, SMALL)
        plans.shift_impact_table(views, UNITS).write.parquet(str(tmp_path / "impact"))
        plans.holiday_status_rates(views, STUDY).write.parquet(str(tmp_path / "rates"))
        assert set(Path(scale.staging_folder(spark)).iterdir()) > before
    assert set(Path(scale.staging_folder(spark)).iterdir()) == before
    assert spark.read.parquet(str(tmp_path / "impact")).count() > 0


def test_a_study_scans_the_shifts_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(plans.status_study, "active_shifts", lambda *a: asked.append(1) or active_shifts(*a))
    text = formatted_plan(plans.holiday_status_rates(DriverViews(spark, SMALL), STUDY))
    assert asked == [1] and text.count("active-shifts") == 1


def test_all_jobs_run_on_one_set_of_sources(spark, tmp_path):
    views, locations = DriverViews(spark, SMALL), {}
    for name in views:
        locations[name] = str(tmp_path / name)
        views[name].write.parquet(locations[name])
    tables = read_sources(spark, locations, "parquet")
    assert tables["option_history"].columns != tables["options"].columns
    assert "meta" not in tables["latest_shifts"].columns
    for job in JOBS.values():
        assert rows(job(tables)) == rows(job(views))


def test_salted_lines_give_the_same_rates(spark):
    panel = spark.createDataFrame(
        [("GB", s, "A" if s % 2 else "B", status, f"c{s // 2}") for s in range(8) for status in ("running", "paused")],
        "country string, fk_subscription long, cohort string, status string, customer_uuid string",
    )
    hot = [("GB", 1, n % 500, f"2024-W{1 + n % 9:02d}") for n in range(3000)]
    lines = spark.createDataFrame(
        hot + [("GB", s, 1000 + s * 10 + n, "2024-W03") for s in range(9) for n in range(s)],
        "country string, fk_subscription long, order_line_items_id long, delivery_week string",
    )
    ranges = {"Pre": ("2024-W01", "2024-W04"), "Post": ("2024-W05", "2024-W08"), "Never": ("2024-W40", "2024-W41")}
    for options in ({}, {"box_counts": True, "per_customer": True}):
        plain = rows(order_rates(panel, lines, ranges, **options))
        assert rows(order_rates(panel, lines, ranges, **options, salts=16)) == plain
    boxes = order_rates(panel, lines, ranges, box_counts=True, per_customer=True).where("cohort = 'A'").first()
    assert boxes["Never_BoxCount"] == 0 and boxes["Never"] == 0.0
    assert boxes["Pre"] == round(boxes["Pre_BoxCount"] / boxes["Total_Customers"], 2)


def test_a_hot_subscription_is_dealt_to_many_partitions(spark):
    lines = spark.range(60_000).selectExpr(
        "'GB' AS country",
        "if(id % 3 = 0, 1L, id % 5000) AS fk_subscription",
        "id AS order_line_items_id",
        "'2024-W03' AS delivery_week",
    )
    marked = lines.withColumn("salt", F.pmod(F.xxhash64("order_line_items_id"), F.lit(SALTS)))
    sizes = [r["count"] for r in marked.groupBy("country", "fk_subscription", "salt").count().collect()]
    assert max(sizes) < 2 * 20_000 / SALTS
    panel = spark.range(5000).selectExpr("'GB' AS country", "id AS fk_subscription", "'A' AS cohort", "'RUNNING' AS status", "concat('c', id) AS customer_uuid")
    ranges = {"Pre": ("2024-W01", "2024-W04")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        panel, lines = staged(panel, "panel"), staged(lines, "lines")  # hides the constants from the plan
        salted, plain = order_rates(panel, lines, ranges, salts=SALTS), order_rates(panel, lines, ranges)
        exchanges = re.findall(r"hashpartitioning\(country#\d+, fk_subscription#\d+L, (salt)#", formatted_plan(salted))
        assert len(exchanges) == 2 and "salt#" not in formatted_plan(plain)
        assert rows(salted) == rows(plain) and plain.first()["Pre"] == 12.0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_staged_dimension_is_measured_while_written(spark):
    df = spark.range(50).selectExpr("id", "concat('name', id) AS name")
    size = table_bytes(df)
    hinted = lambda out: "ResolvedHint" in out._jdf.queryExecution().analyzed().toString()
    assert hinted(staged_dimension(df, "fits", size)) and not hinted(staged_dimension(df, "large", size - 1))
    empty = staged_dimension(df.limit(0), "empty", 1)
    assert hinted(empty) and empty.count() == 0


def test_steps_side_by_side_keep_their_order_and_raise(spark):
    steps = [lambda k=k: staged(spark.range(k), f"step-{k}") for k in (3, 1, 2)]
    assert [df.count() for df in together(spark, *steps)] == [3, 1, 2]
    with pytest.raises(ZeroDivisionError):
        together(spark, steps[0], lambda: 1 // 0)
