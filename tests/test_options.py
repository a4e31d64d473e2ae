import decimal

from pyspark.sql import functions as F

from shiftlab.operators.options import delivery_options, option_change_flags
from tests.helpers import rows, table

SHIFT_COLUMNS = (
    "business_unit string, origin_option_handle string, target_option_handle string, "
    "origin_date string, target_date string, postal_code string"
)


def option(handle, **change):
    row = {
        "region_code": "GB",
        "option_handle": handle,
        "cutoff": 5,
        "surcharge_price": decimal.Decimal("1.50"),
        "packing_day": "MONDAY",
        "fk_imported_at": 20240105,
        "start_time": "08:00:00",
        "end_time": "12:00:00",
    }
    return {**row, **change}


def entities(spark):
    return table(
        spark,
        "entities",
        [
            {"country_group": "UK", "country": "England", "entity_code": "GB"},
            {"country_group": "UK", "country": "Wales", "entity_code": "GB"},
            {"country_group": "DACH", "country": "Germany", "entity_code": "DE"},
        ],
    )


def flags(spark, options, shift):
    known = delivery_options(
        table(spark, "options", options), entities(spark), 20240101, ["GB"], with_slot=True
    )
    shifts = spark.createDataFrame([shift], SHIFT_COLUMNS)
    flagged = option_change_flags(shifts, known)
    return rows(flagged.select(*flagged.columns[6:]))


def shift(origin, target, target_date="2024-01-30"):
    return ("GB", origin, target, "2024-01-29", target_date, "M1")


def test_restrictions_by_region_and_by_entity_country(spark):
    df = table(
        spark,
        "options",
        [
            option("a"),
            option("b", fk_imported_at=20231231),
            option("c", region_code="XX"),
            option("d", region_code="DE"),
        ],
    )
    by_region = delivery_options(df, entities(spark), 20240101, regions=["GB", "XX"])
    assert rows(by_region, "option_handle", "market", "country") == [
        ("a", "UK", "GB"),
        ("c", None, None),
    ]
    by_country = delivery_options(
        df, entities(spark), 20240101, entity_countries=["Wales", "England"], with_slot=True
    )
    assert rows(by_country, "option_handle", "delivery_time") == [("a", "08:00-12:00")]


def test_equal_options(spark):
    assert flags(spark, [option("a"), option("b")], shift("a", "b", "2024-01-29")) == [
        (False, False, False, False, False)
    ]


def test_cutoff_day_follows_each_side_own_date(spark):
    later = [option("a"), option("b")]
    assert flags(spark, later, shift("a", "b")) == [(False, False, False, True, False)]
    shorter = [option("a"), option("b", cutoff=6)]
    assert flags(spark, shorter, shift("a", "b")) == [(False, False, True, False, False)]


def test_differing_options(spark):
    other = option(
        "b",
        packing_day="MONTAG",
        surcharge_price=decimal.Decimal("0.00"),
        end_time="13:00:00",
    )
    assert flags(spark, [option("a"), other], shift("a", "b", None)) == [
        (False, True, False, False, True)
    ]


def test_missing_sides_are_unknown_but_for_the_slot(spark):
    assert flags(spark, [option("a")], shift("a", "D-0800-1200")) == [
        (None, None, None, None, True)
    ]
    assert flags(spark, [], shift("D-1-0800-1200", "D-2-0800-1200")) == [
        (None, None, None, None, False)
    ]
    assert flags(spark, [], shift("none", "nothing")) == [(None, None, None, None, False)]
    assert flags(spark, [], shift("none", None)) == [(None, None, None, None, None)]


def test_slots_compare_equal_when_normalised(spark):
    known = delivery_options(
        table(spark, "options", [option("a")]), entities(spark), 20240101, ["GB"], with_slot=True
    )
    shifts = spark.createDataFrame([shift("a", "D-0800-1200")], SHIFT_COLUMNS)
    flagged = option_change_flags(shifts, known, normalise_slots=True)
    assert flagged.select(F.col("delivery_time_shift")).first()[0] is False


def test_option_versions_fan_out_only_where_they_differ(spark):
    versions = [
        option("a"),
        option("a", fk_imported_at=20240120),
        option("a", fk_imported_at=20240125, surcharge_price=decimal.Decimal("0.00")),
        option("b"),
    ]
    assert flags(spark, versions, shift("a", "b", "2024-01-29")) == [
        (False, False, False, False, False),
        (False, True, False, False, False),
    ]
