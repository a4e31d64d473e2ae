"""Control-versus-shifted comparison of order-rate drops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.operators.compare import control_comparison
from shiftlab.operators.orders import order_rate_deltas

METRICS = ("Delta_5W", "Delta_10W")


def comparison_input(
    rates: DataFrame, holiday: str, origin_date: str, status: str | None = "running"
) -> DataFrame:
    """Order rates by country as comparison rows: deltas, holiday and date added, one status kept."""
    if status is not None:
        rates = rates.filter(F.col("Status") == status)
    spans = ("10W", "5W")
    shorter = {
        f"{side}_{span}_AOR": f"{side}_{span}" for side in ("Pre", "Post") for span in spans
    }
    named = rates.withColumnsRenamed(shorter).withColumns(
        {"Holiday": F.lit(holiday), "Origin Date": F.to_date(F.lit(origin_date))}
    )
    return order_rate_deltas(named).select(
        "Country",
        "Origin Date",
        "Holiday",
        F.col("Cohort").alias("cohort"),
        F.col("Status").alias("status"),
        *[f"{side}_{span}" for side, span in (("Pre", "10W"), ("Pre", "5W"))],
        *[f"{side}_{span}" for side, span in (("Post", "5W"), ("Post", "10W"))],
        *METRICS,
    )


def control_report(
    rows: DataFrame,
    order_by: Sequence[str] = ("ordinal",),
    metrics: Sequence[str] = METRICS,
    keys: Sequence[str] = ("Country", "Holiday"),
) -> DataFrame:
    """One row per metric: how often the control cohort's drop was no larger."""
    return control_comparison(rows, metrics, order_by, keys)
