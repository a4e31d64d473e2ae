"""Explicit schemas of the source tables. Dates are ISO strings unless the name says otherwise."""

from __future__ import annotations

from pyspark.sql import types as T

_META = T.StructType([T.StructField("operation", T.StringType())])


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_TEXT, _INT, _LONG, _FLAG = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
_STATUSES = {f"status_wk_{week}": _TEXT for week in range(5)}
_OPTION = {
    "region_code": _TEXT,
    "option_handle": _TEXT,
    "cutoff": _INT,
    "surcharge_price": T.DecimalType(10, 2),
    "packing_day": _TEXT,
    "delivery_day": _TEXT,
    "production_capacity": _INT,
    "fk_imported_at": _INT,
}

SCHEMAS = {
    "shifts": _schema(
        business_unit=_TEXT,
        shift_id=_TEXT,
        postal_code=_TEXT,
        origin_option_handle=_TEXT,
        target_option_handle=_TEXT,
        origin_date=_TEXT,
        target_date=_TEXT,
        visible_to_customer=_FLAG,
        fk_imported_at=_TEXT,
        published_time=_TEXT,
        meta=_META,
    ),
    "latest_shifts": _schema(
        business_unit=_TEXT,
        origin_option_handle=_TEXT,
        target_option_handle=_TEXT,
        origin_date=_TEXT,
        target_date=_TEXT,
        postal_code=_TEXT,
        published_time=_TEXT,
    ),
    "changes": _schema(
        business_unit=_TEXT,
        fk_subscription=_LONG,
        delivery_weekday=_INT,
        delivery_time=_TEXT,
        week_id=_TEXT,
    ),
    "calendar": _schema(
        calendar_date=_TEXT, delivery_week=_TEXT, day_of_week=_INT, day_name=_TEXT
    ),
    "entities": _schema(country_group=_TEXT, country=_TEXT, entity_code=_TEXT),
    "snapshots": _schema(
        country=_TEXT,
        fk_subscription=_LONG,
        fk_imported_at_date=_INT,
        delivery_wk_4=_TEXT,
        delivery_time=_TEXT,
        zip=_TEXT,
        **_STATUSES,
    ),
    "status_snapshots": _schema(
        country=_TEXT, fk_subscription=_LONG, fk_imported_at_date=_INT, **_STATUSES
    ),
    "order_items": _schema(
        region_code=_TEXT,
        postal_code=_TEXT,
        subscription_nk=_LONG,
        delivery_option_handle=_TEXT,
        delivery_week=_TEXT,
        is_delivered=_FLAG,
        is_mealbox=_FLAG,
        meta=_META,
    ),
    "option_history": _schema(**_OPTION),
    "options": _schema(**_OPTION, start_time=_TEXT, end_time=_TEXT),
    "order_lines": _schema(
        subscription_id=_LONG,
        customer_uuid=_TEXT,
        create_date=_TEXT,
        order_line_items_id=_LONG,
        entity_code=_TEXT,
        delivery_week=_TEXT,
        order_item_type=_TEXT,
    ),
}

COMPARISON_SCHEMA = T.StructType(
    [
        T.StructField("Country", _TEXT),
        T.StructField("Origin Date", T.DateType()),
        T.StructField("Holiday", _TEXT),
        T.StructField("cohort", _TEXT),
        T.StructField("status", _TEXT),
        *[
            T.StructField(name, T.DoubleType())
            for name in ("Pre_10W", "Pre_5W", "Post_5W", "Post_10W", "Delta_5W", "Delta_10W")
        ],
    ]
)
