"""Delivery outcomes and the number of subscriptions each shift affects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.functions import cutoff_day
from shiftlab.operators.options import with_both_options
from shiftlab.operators.shifts import not_deleted
from shiftlab.operators.subscriptions import SUBSCRIPTION

OUTCOME_KEY = [*SUBSCRIPTION, "zip", "updated_delivery_time", "delivery_week"]
SHIFT_KEY = ["country", "postal_code", "origin_option_handle", "origin_date"]


def delivery_outcomes(
    order_items: DataFrame,
    min_week: str,
    excluded_regions: Sequence[str] = ("CA", "US"),
    dedupe: bool = True,
) -> DataFrame:
    """Whether a subscription's mealbox reached the postcode in its slot that week.

    Only the key and the outcome are kept before duplicates go, so the order items' many other
    columns are never read.
    """
    outcomes = (
        not_deleted(order_items)
        .filter(
            ~F.col("region_code").isin(*excluded_regions)
            & F.col("is_mealbox")
            & (F.col("delivery_week") >= min_week)
        )
        .select(
            F.col("region_code").alias("country"),
            F.col("subscription_nk").alias("fk_subscription"),
            F.col("postal_code").alias("zip"),
            F.col("delivery_option_handle").alias("updated_delivery_time"),
            "delivery_week",
            "is_delivered",
        )
    )
    return outcomes.distinct() if dedupe else outcomes


def planned_deliveries(
    snapshots: DataFrame, units: Sequence[str], min_date: str
) -> DataFrame:
    """Planned deliveries from a date on; the same plan repeats in many snapshots."""
    return snapshots.filter(
        F.col("country").isin(*units) & (F.col("delivery_wk_4") >= min_date)
    ).select(*SUBSCRIPTION, "delivery_wk_4", "delivery_time", "zip")


def affected_subscriptions(subscriptions: DataFrame) -> DataFrame:
    """Distinct subscriptions per shift key and outcome.

    Counted before the shifts are joined: a shift only ever sees the subscriptions of its own key,
    and the many rows of a popular key shrink to one per outcome in the partial aggregate.
    """
    return (
        subscriptions.select(
            "country",
            F.col("zone").alias("postal_code"),
            F.col("updated_delivery_time").alias("origin_option_handle"),
            F.col("updated_delivery_date").alias("origin_date"),
            "is_delivered",
            "fk_subscription",
        )
        .groupBy(*SHIFT_KEY, "is_delivered")
        .agg(F.count_distinct("fk_subscription").alias("subscription_count"))
    )


def shift_impact(
    registry: DataFrame, options: DataFrame, affected: DataFrame, min_week: str
) -> DataFrame:
    """Every shift with its option attributes on both sides and its affected subscriptions.

    Shifts nobody is affected by stay, with a count of 0. Both cutoff days count back from the
    origin date.
    """
    attributes = ("packing_day", "cutoff", "surcharge_price")
    # Distinct while they are few and narrow: what is joined to them has one row per key and version.
    shifts = (
        registry.filter(F.col("delivery_week") >= min_week)
        .drop("imported_on", "business_unit")
        .withColumn("target_date", F.coalesce("target_date", "origin_date"))
        .distinct()
    )
    both = with_both_options(
        shifts.withColumn("business_unit", F.col("country")), options, attributes
    )
    return (
        both.join(affected, SHIFT_KEY, "left")
        .select(
            "market",
            "country",
            "shift_id",
            "postal_code",
            "visible_to_customer",
            "published_date",
            "origin_packing_day",
            F.col("origin_cutoff").alias("origin_cutoff_value"),
            cutoff_day(F.col("origin_date"), F.col("origin_cutoff")).alias("origin_cutoff_name"),
            "origin_surcharge_price",
            "target_packing_day",
            F.col("target_cutoff").alias("target_cutoff_value"),
            cutoff_day(F.col("origin_date"), F.col("target_cutoff")).alias("target_cutoff_name"),
            "target_surcharge_price",
            F.col("origin_option_handle").alias("updated_origin_time_handle"),
            "target_option_handle",
            F.col("origin_date").alias("updated_origin_date"),
            F.col("target_date").alias("updated_target_date"),
            "delivery_week",
            F.datediff("target_date", "origin_date").alias("day_difference"),
            "is_delivered",
            F.coalesce("subscription_count", F.lit(0)).alias("subscription_count"),
        )
    )
