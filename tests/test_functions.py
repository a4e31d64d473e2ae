from pyspark.sql import functions as F

from shiftlab.functions import (
    cohort_letter,
    compact_date,
    cutoff_day,
    day_number,
    holiday_week_status,
    slot_text,
    time_slot,
    zone_extended,
    zone_simple,
)
from tests.helpers import rows


def zones(spark, rule, pairs):
    df = spark.createDataFrame(pairs, "country string, zip string")
    return {(r[0], r[1]): r[2] for r in rows(df.withColumn("z", rule(F.col("country"), F.col("zip"))))}


def test_simple_zones(spark):
    cases = {
        ("GB", "SW1A 1AA"): "SW1A",
        ("GB", "M1 1AA"): "M1",
        ("GB", "M11AA"): "M1",
        ("GB", "m1 1aa"): "m1",
        ("GB", "AB"): "",
        ("IE", "D02X285"): "D02",
        ("IE", "D02"): "",
        ("NL", "1234 AB"): "1234 AB",
        ("NL", "NL5042ZK"): "5042",
        ("FR", "75001"): "75001",
        ("FR", "ab"): "ab",
        ("FR", None): None,
        (None, "75001"): "75001",
    }
    assert zones(spark, zone_simple, list(cases)) == cases


def test_simple_zones_with_the_dutch_rule_repaired(spark):
    cases = {
        ("NL", "1234 AB"): "1234 ",
        ("NL", "1234AB"): "1234",
        ("NL", "NL5042ZK"): "5042",
        ("NL", "1234"): "1234",
        ("GB", "M1 1AA"): "M1",
    }
    assert zones(spark, lambda c, z: zone_simple(c, z, fix_nl=True), list(cases)) == cases


def test_extended_zones(spark):
    cases = {
        ("GB", "SW1A 1AA"): "SW1A",
        ("GB", "M1 1AA"): "M1 1",
        ("GB", "m11aa"): "M1",
        ("GN", "AB"): "",
        ("IE", "d02X285"): "d02",
        ("NL", "1234 ab"): "1234",
        ("TT", "1234 ab"): "1234",
        ("NL", "NL5042ZK"): "NL5042",
        ("NL", "A"): "",
        ("FR", "2a004"): "2A004",
        (None, "m11aa"): "M11AA",
        ("GB", None): None,
    }
    assert zones(spark, zone_extended, list(cases)) == cases


def test_status_windows(spark):
    days = {
        20231231: "Other",
        20240101: "s4",
        20240107: "s4",
        20240108: "s3",
        20240114: "s3",
        20240115: "s2",
        20240121: "s2",
        20240122: "s1",
        20240128: "s1",
        20240129: "s0",
        20240204: "s0",
        20240205: "Other",
    }
    df = spark.createDataFrame([(d, "s0", "s1", "s2", "s3", "s4") for d in days]).toDF(
        "day", *[f"status_wk_{k}" for k in range(5)]
    )
    status = holiday_week_status(F.col("day"), "2024-01-01")
    assert dict(rows(df.select("day", status))) == days


def test_status_windows_cross_months_and_years(spark):
    df = spark.createDataFrame(
        [(20231228, "a", "b"), (20240103, "a", "b"), (20240104, "a", "b")],
        "day int, status_wk_4 string, status_wk_3 string",
    )
    for k in range(3):
        df = df.withColumn(f"status_wk_{k}", F.lit("x"))
    status = holiday_week_status(F.col("day"), "2023-12-28")
    assert dict(rows(df.select("day", status))) == {20231228: "a", 20240103: "a", 20240104: "b"}


def test_dates_and_texts(spark):
    df = spark.createDataFrame(
        [("2024-04-01", 5, "D-1-0800-1200", "08:00:00", "12:00", "2024-01-05T08:00:00", "Cohort B (-1)")],
        "d string, n int, h string, a string, b string, p string, c string",
    )
    got = df.select(
        cutoff_day(F.col("d"), F.col("n")),
        cutoff_day(F.col("d"), F.lit("0")),
        time_slot(F.col("h")),
        time_slot(F.lit("none")),
        slot_text(F.col("a"), F.col("b")),
        compact_date(F.col("p")),
        cohort_letter(F.col("c")),
        cohort_letter(F.lit("other")),
    ).first()
    assert tuple(got) == ("WED", "MON", "0800-1200", "", "08:00-12:00", "20240105", "B", None)
    assert day_number("2024-01-05") == 20240105
