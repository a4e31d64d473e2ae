"""Holiday shifts: which zone and option moved from which date to which."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.functions import compact_date

DELETED = "d"


def not_deleted(df: DataFrame) -> DataFrame:
    """Drop soft-deleted rows. A row without an operation mark is dropped as well."""
    return df.filter(F.col("meta.operation") != DELETED)


def entity_codes(entities: DataFrame) -> DataFrame:
    """One row per (market, entity code); the entity table repeats codes per country."""
    return entities.select(
        F.col("country_group").alias("market"), F.col("entity_code")
    ).distinct()


def active_shifts(
    shifts: DataFrame, units: Sequence[str], origin_date: str, drop_deleted: bool = True
) -> DataFrame:
    """Distinct shifts of the given units away from one holiday."""
    picked = shifts.filter(
        F.col("business_unit").isin(*units) & (F.col("origin_date") == origin_date)
    )
    if drop_deleted:
        picked = not_deleted(picked)
    return picked.select(
        "business_unit",
        "origin_option_handle",
        "target_option_handle",
        "origin_date",
        "target_date",
        "postal_code",
        compact_date(F.col("published_time")).alias("published_date"),
    ).distinct()


def publication_start(active: DataFrame) -> DataFrame:
    """One row: the first day any of the shifts was public (NULL when there is none)."""
    return active.agg(F.min("published_date").alias("publication_date"))


def with_publication_start(df: DataFrame, active: DataFrame) -> DataFrame:
    """Attach the publication start to every row, as a scalar subquery."""
    return df.withColumn("publication_date", publication_start(active).scalar())


def shift_registry(
    shifts: DataFrame,
    entities: DataFrame,
    calendar: DataFrame,
    units: Sequence[str],
    min_year: str,
) -> DataFrame:
    """First publication of every live shift, with market, entity code and week of the holiday."""
    live = not_deleted(shifts).filter(
        F.col("business_unit").isin(*units) & (F.col("origin_date") >= min_year)
    )
    codes = entity_codes(entities)
    weeks = calendar.select(
        F.col("calendar_date").alias("origin_date"), "delivery_week"
    ).distinct()
    shift_key = [
        "business_unit",
        "shift_id",
        "postal_code",
        "origin_option_handle",
        "target_option_handle",
        "origin_date",
        "target_date",
        "visible_to_customer",
        "imported_on",
    ]
    first = (
        live.withColumn("imported_on", F.substring("fk_imported_at", 1, 8))
        .groupBy(*shift_key)
        .agg(F.min(compact_date(F.col("published_time"))).alias("published_date"))
    )
    return (
        first.join(codes, first["business_unit"] == codes["entity_code"], "left")
        .join(weeks, "origin_date", "left")
        .select(
            "market",
            F.col("entity_code").alias("country"),
            *shift_key,
            "delivery_week",
            "published_date",
        )
    )
