"""Delivery options and how they differ between the two sides of a shift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlab.functions import cutoff_day, slot_text, time_slot
from shiftlab.operators.shifts import entity_codes

FLAGS = (
    "packing_day_shifted",
    "surcharge_shifted",
    "cutoff_value_shifted",
    "cutoff_day_shifted",
    "delivery_time_shift",
)


def delivery_options(
    options: DataFrame,
    entities: DataFrame,
    min_import: int,
    regions: Sequence[str] | None = None,
    entity_countries: Sequence[str] | None = None,
    with_slot: bool = False,
) -> DataFrame:
    """Option attributes with market and entity code.

    Restrict either by the option's own region code, which keeps regions unknown to the entity
    table, or by the entity's country, which does not. ``with_slot`` adds ``HH:MM-HH:MM``.
    """
    picked = options.filter(F.col("fk_imported_at") >= min_import)
    if regions is not None:
        picked = picked.filter(F.col("region_code").isin(*regions))
    how = "left"
    if entity_countries is not None:
        entities = entities.filter(F.col("country").isin(*entity_countries))
        how = "inner"
    codes = entity_codes(entities)
    slot = [slot_text(F.col("start_time"), F.col("end_time")).alias("delivery_time")]
    return picked.join(codes, picked["region_code"] == codes["entity_code"], how).select(
        "market",
        F.col("entity_code").alias("country"),
        "option_handle",
        *(slot if with_slot else []),
        "cutoff",
        "surcharge_price",
        "packing_day",
        "delivery_day",
        "production_capacity",
        "fk_imported_at",
    )


def _side(options: DataFrame, side: str, attributes: Sequence[str]) -> DataFrame:
    """Distinct attribute versions per option, named for one side of the shift."""
    return options.select(
        F.col("country").alias("business_unit"),
        F.col("option_handle").alias(f"{side}_option_handle"),
        *[_attribute(a).alias(f"{side}_{a}") for a in attributes],
    ).distinct()


def _attribute(name: str) -> Column:
    """An option attribute; of the packing day, whose spelling varies, three letters count."""
    return F.left(F.col(name), F.lit(3)) if name == "packing_day" else F.col(name)


def with_both_options(
    shifts: DataFrame, options: DataFrame, attributes: Sequence[str]
) -> DataFrame:
    """Option attributes of the origin and the target handle next to every shift.

    A handle with several attribute versions gives one row per version; versions that do not
    differ in the requested attributes are merged first.
    """
    origin = _side(options, "origin", attributes)
    target = _side(options, "target", attributes)
    return shifts.join(origin, ["business_unit", "origin_option_handle"], "left").join(
        target, ["business_unit", "target_option_handle"], "left"
    )


def _slot_or_handle(side: str, normalise: bool) -> Column:
    known = F.col(f"{side}_delivery_time")
    if normalise:
        known = F.replace(known, F.lit(":"), F.lit(""))
    return F.coalesce(known, time_slot(F.col(f"{side}_option_handle")))


def option_change_flags(
    shifts: DataFrame, options: DataFrame, normalise_slots: bool = False
) -> DataFrame:
    """Five flags per shift: does the option attribute differ between origin and target?

    A flag is NULL when either side has no option row; the delivery time then falls back to the
    slot in the handle, which is written without colons and so never equals a known slot unless
    ``normalise_slots`` is set. All inputs of the flags are properties of the shift, so they are
    settled here, before any subscription is matched.
    """
    attributes = ("packing_day", "surcharge_price", "cutoff", "delivery_time")
    both = with_both_options(shifts, options, attributes)

    def differs(attribute: str) -> Column:
        return F.col(f"origin_{attribute}") != F.col(f"target_{attribute}")

    new_date = F.coalesce("target_date", "origin_date")
    return both.select(
        *shifts.columns,
        differs("packing_day").alias("packing_day_shifted"),
        differs("surcharge_price").alias("surcharge_shifted"),
        differs("cutoff").alias("cutoff_value_shifted"),
        (
            cutoff_day(F.col("origin_date"), F.col("origin_cutoff"))
            != cutoff_day(new_date, F.col("target_cutoff"))
        ).alias("cutoff_day_shifted"),
        (
            _slot_or_handle("origin", normalise_slots)
            != _slot_or_handle("target", normalise_slots)
        ).alias("delivery_time_shift"),
    ).distinct()
