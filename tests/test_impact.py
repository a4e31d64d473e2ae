import decimal

from shiftlab import plans
from shiftlab.operators.impact import delivery_outcomes
from shiftlab.sources import read_source, write_table
from tests.helpers import calendar, rows, table
from tests.test_shifts import shift
from tests.test_subscriptions import change, snap


def item(sub, delivered, **change):
    row = {
        "region_code": "GB",
        "postal_code": "M11 1AA",
        "subscription_nk": sub,
        "delivery_option_handle": "a",
        "delivery_week": "2024-W05",
        "is_delivered": delivered,
        "is_mealbox": True,
        "meta": ("u",),
    }
    return {**row, **change}


def option(handle, cutoff, **change):
    row = {
        "region_code": "GB",
        "option_handle": handle,
        "cutoff": cutoff,
        "surcharge_price": decimal.Decimal("1.50"),
        "packing_day": "MONDAY",
        "fk_imported_at": 20240105,
    }
    return {**row, **change}


def source_tables(spark):
    zone = "M11 "  # the first four characters of the postcode
    return {
        "calendar": calendar(spark),
        "entities": table(
            spark,
            "entities",
            [
                {"country_group": "UK", "country": c, "entity_code": "GB"}
                for c in ("England", "Wales")
            ],
        ),
        "shifts": table(
            spark,
            "shifts",
            [
                shift(postal_code=zone),
                shift(postal_code=zone, fk_imported_at="20240104T0600"),
                shift(shift_id="nobody", postal_code="X"),
                shift(shift_id="unmoved", postal_code=zone, origin_option_handle="b", target_date=None),
                shift(shift_id="deleted", postal_code=zone, meta=("d",)),
                shift(shift_id="undated", postal_code=zone, origin_date="2030-01-01"),
            ],
        ),
        "option_history": table(
            spark,
            "option_history",
            [option("a", 5), option("a", 5, fk_imported_at=20240110), option("b", 6)],
        ),
        "snapshots": table(
            spark,
            "snapshots",
            [
                snap(1, 20240101),
                snap(1, 20240102),
                snap(2, 20240101),
                snap(3, 20240101),
                snap(4, 20240101, "2024-01-31"),
                snap(5, 20240101, code="ZZ9 9ZZ"),
                snap(6, 20240101, country="FR"),
                snap(7, 20240101, "2024-02-07"),
            ],
        ),
        "changes": table(
            spark,
            "changes",
            [change(3, 1, "b"), change(4, 1, "a"), change(4, 1, "a"), change(2, 3, "a")],
        ),
        "order_items": table(
            spark,
            "order_items",
            [
                item(1, True),
                item(1, False),
                item(1, True),
                item(4, None),
                item(3, True),
                item(1, None, is_mealbox=False),
                item(1, None, meta=("d",)),
                item(1, None, meta=(None,)),
                item(1, None, delivery_week="2023-W52"),
                item(1, None, region_code="US"),
                item(1, None, postal_code="other"),
            ],
        ),
    }


COLUMNS = ("shift_id", "is_delivered", "subscription_count")


def test_outcomes(spark):
    outcomes = delivery_outcomes(source_tables(spark)["order_items"], "2024-W01")
    assert rows(outcomes, "fk_subscription", "zip", "is_delivered") == [
        (1, "M11 1AA", False),
        (1, "M11 1AA", True),
        (1, "other", None),
        (3, "M11 1AA", True),
        (4, "M11 1AA", None),
    ]


def test_shift_impact_table(spark):
    impact = plans.shift_impact_table(source_tables(spark), ["GB", "FR"])
    assert rows(impact, *COLUMNS) == [
        ("nobody", None, 0),
        ("s1", None, 1),
        ("s1", False, 1),
        ("s1", True, 1),
        ("unmoved", None, 1),
    ]
    assert rows(
        impact.filter("shift_id != 's1'"),
        "shift_id",
        "market",
        "origin_cutoff_value",
        "target_cutoff_value",
        "origin_cutoff_name",
        "target_cutoff_name",
        "updated_origin_date",
        "updated_target_date",
        "day_difference",
    ) == [
        ("nobody", "UK", 5, 6, "WED", "TUE", "2024-01-29", "2024-01-30", 1),
        ("unmoved", "UK", 6, 6, "TUE", "TUE", "2024-01-29", "2024-01-29", 0),
    ]


def test_option_history_fans_out_only_where_attributes_differ(spark):
    tables = source_tables(spark)
    cheaper = option("a", 5, surcharge_price=decimal.Decimal("0.00"))
    tables["option_history"] = tables["option_history"].union(table(spark, "option_history", [cheaper]))
    impact = plans.shift_impact_table(tables, ["GB", "FR"]).filter("shift_id = 'nobody'")
    assert rows(impact, "origin_surcharge_price") == [
        (decimal.Decimal("0.00"),),
        (decimal.Decimal("1.50"),),
    ]


def test_result_goes_to_files_and_tables(spark, tmp_path):
    impact = plans.shift_impact_table(source_tables(spark), ["GB", "FR"])
    path = str(tmp_path / "impact")
    write_table(impact, path, partition_by=["country", "delivery_week"])
    assert rows(spark.read.parquet(path), *COLUMNS) == rows(impact, *COLUMNS)
    write_table(impact, "impact_enriched", as_table=True)
    assert rows(spark.table("impact_enriched"), *COLUMNS) == rows(impact, *COLUMNS)
    for fmt in ("orc", "json"):
        write_table(impact, str(tmp_path / fmt), fmt=fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == 5


def test_sources_under_other_names_and_types(spark, tmp_path):
    shifts = source_tables(spark)["shifts"]
    other = shifts.selectExpr(
        "business_unit AS unit",
        "* EXCEPT (business_unit, visible_to_customer, meta)",
        "int(visible_to_customer) AS visible_to_customer",
        "struct(meta.operation AS op) AS audit",
    )
    path = str(tmp_path / "shifts")
    other.write.parquet(path)
    read = read_source(
        spark,
        "shifts",
        path,
        "parquet",
        {"business_unit": "unit", "meta": "struct(audit.op AS operation)"},
    )
    assert read.dtypes == shifts.dtypes
    assert rows(read) == rows(shifts)
