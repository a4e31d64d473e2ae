"""How often the unshifted control cohort did at least as well as the shifted ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.functions import cohort_letter


def control_comparison(
    rates: DataFrame,
    metrics: Sequence[str],
    order_by: Sequence[str],
    keys: Sequence[str] = ("Country", "Holiday"),
    control: str = "A",
) -> DataFrame:
    """Per metric: comparisons of a group's control row with its other rows, and how many it wins.

    The control of a group is its first control row by ``order_by``; groups without one, or with
    an unknown key, are left out. A smaller drop wins, a tie counts for the control, and a missing
    value on either side wins nothing but is still a comparison.
    """
    known = rates.dropna(subset=list(keys)).withColumns(
        {
            "letter": cohort_letter(F.col("cohort")),
            **{m: F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")) for m in metrics},
        }
    )
    first = F.struct(*order_by)
    controls = (
        known.filter(F.col("letter") == control)
        .groupBy(*keys)
        .agg(*[F.min_by(m, first).alias(f"control_{m}") for m in metrics])
    )
    others = known.filter(~F.col("letter").eqNullSafe(F.lit(control)))
    counts = others.join(controls, list(keys)).agg(
        F.count("*").alias("comparisons"),
        *[F.count_if(F.col(f"control_{m}") <= F.col(m)).alias(m) for m in metrics],
    )
    return counts.unpivot("comparisons", list(metrics), "metric", "better_or_equal").select(
        "metric",
        "better_or_equal",
        "comparisons",
        F.when(
            F.col("comparisons") > 0,
            # Ties go to the even digit, as in printed reports.
            F.format_number(F.col("better_or_equal") / F.col("comparisons") * 100, 1).cast("double"),
        )
        .otherwise(F.lit(0.0))
        .alias("percentage"),
    )
