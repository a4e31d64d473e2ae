"""The enriched shift table: every shift, its options on both sides, and whom it affects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.operators.impact import (
    OUTCOME_KEY,
    affected_subscriptions,
    delivery_outcomes,
    planned_deliveries,
    shift_impact,
)
from shiftlab.operators.options import delivery_options
from shiftlab.operators.scale import SHIFT_BYTES, dimension, staged, staged_dimension, together
from shiftlab.operators.shifts import shift_registry
from shiftlab.operators.subscriptions import (
    SUBSCRIPTION,
    code_lookup,
    one_off_changes,
    week_lookup,
    with_extended_zone,
    with_week,
)

SUBSCRIPTION_WEEK = [*SUBSCRIPTION, "delivery_week"]


def _by_week(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of the columns, clustered by subscription and week.

    Distinct after the one shuffle: what repeats is spread over days and files, so little of it would
    collapse before.
    """
    return df.select(*SUBSCRIPTION_WEEK, *columns).repartition(*SUBSCRIPTION_WEEK).distinct()


def shifted_deliveries(
    tables: Mapping[str, DataFrame],
    shifts: DataFrame,
    units: Sequence[str],
    min_week: str,
    min_date: str,
) -> DataFrame:
    """Deliveries, after one-off changes, that one of the shifts moves, with their outcome.

    The shifts decide early what is read. A one-off change keeps the postcode and stays within its
    week, so only plans whose zone has a shift in their week can land on a shifted date; changes
    and outcomes are limited by country and week. Plans and changes meet on one clustering,
    subscription and week, and what no shift moves is dropped before outcomes are looked up. An
    outcome is one of three values, so those of one delivery are three bits of a number.
    """
    spark = shifts.sparkSession
    week_key = ["country", "delivery_week"]
    # One number per zone and week; should two be equal, the exact key below decides.
    zone_week = F.xxhash64("country", "delivery_week", "zone").alias("zone_week")
    zones = shifts.select("country", "delivery_week", F.col("postal_code").alias("zone"))
    shift_key = shifts.select(
        "country",
        F.col("postal_code").alias("zone"),
        F.col("origin_option_handle").alias("updated_delivery_time"),
        F.col("origin_date").alias("updated_delivery_date"),
    )
    # Lookups are measured, used more than once and small: each is written once.
    calendar, days, codes, weeks, zone_weeks, keys = together(
        spark,
        lambda: dimension(tables["calendar"]),
        lambda: staged_dimension(week_lookup(tables["calendar"]), "weeks-of-days"),
        lambda: staged_dimension(code_lookup(tables["entities"]), "entity-codes"),
        lambda: staged_dimension(shifts.select(*week_key).distinct(), "shift-weeks"),
        lambda: staged_dimension(zones.select(zone_week).distinct(), "shift-zones", SHIFT_BYTES),
        lambda: staged_dimension(shift_key.distinct(), "shift-keys", SHIFT_BYTES),
    )
    planned = with_week(planned_deliveries(tables["snapshots"], units, min_date), days)
    zoned = with_extended_zone(planned, codes).withColumn("zone_week", zone_week)
    plans = _by_week(
        zoned.join(zone_weeks, "zone_week", "left_semi"), "delivery_wk_4", "delivery_time", "zip"
    )
    one_offs = one_off_changes(
        tables["changes"], calendar, units, min_week, dedupe=False, weeks=weeks
    ).withColumnRenamed("business_unit", "country")
    changes = _by_week(one_offs, "changed_delivery_time", "changed_delivery_date")
    moved = plans.join(changes, SUBSCRIPTION_WEEK, "left").select(
        *SUBSCRIPTION_WEEK,
        "zip",
        F.coalesce("changed_delivery_time", "delivery_time").alias("updated_delivery_time"),
        F.coalesce("changed_delivery_date", "delivery_wk_4").alias("updated_delivery_date"),
    )
    shifted = with_extended_zone(moved, codes).join(keys, keys.columns, "left_semi")
    delivered = delivery_outcomes(tables["order_items"], min_week, dedupe=False)
    bit = F.when(F.col("is_delivered"), 1).when(~F.col("is_delivered"), 2).otherwise(4)
    outcomes = (
        delivered.join(weeks, week_key, "left_semi").groupBy(*OUTCOME_KEY).agg(F.bit_or(bit).alias("seen"))
    )
    values = F.array(F.lit(True), F.lit(False), F.lit(None))
    own = F.filter(values, lambda _, i: F.getbit(F.col("seen"), i) == 1)
    return shifted.join(outcomes, OUTCOME_KEY, "left").select(
        *shifted.columns, F.explode_outer(own).alias("is_delivered")
    )


def shift_impact_table(
    tables: Mapping[str, DataFrame],
    units: Sequence[str],
    min_year: str = "2024",
    min_week: str = "2024-W01",
    min_date: str = "2024-01-01",
    min_import: int = 20240101,
) -> DataFrame:
    """One row per shift, option attributes and outcome, with distinct affected subscriptions.

    ``tables`` needs ``shifts``, ``entities``, ``calendar``, ``snapshots``, ``changes``,
    ``option_history`` and ``order_items``. Write the result with ``sources.write_table``.
    """
    registry = staged(
        shift_registry(tables["shifts"], tables["entities"], tables["calendar"], units, min_year),
        "shift-registry",
    )
    in_scope = registry.filter(F.col("delivery_week") >= min_week)
    deliveries = shifted_deliveries(tables, in_scope, units, min_week, min_date)
    options = delivery_options(
        tables["option_history"], tables["entities"], min_import, regions=units
    )
    return shift_impact(in_scope, options, affected_subscriptions(deliveries), min_week)
