"""Order lines of cohort members and orders per ordering customer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.operators.scale import keep_known
from shiftlab.operators.subscriptions import SUBSCRIPTION

# Join partitions a subscription's order lines are dealt to where nothing is broadcast.
SALTS = 16


def _order_lines(
    order_lines: DataFrame,
    units: Sequence[str],
    weeks: tuple[str, str],
    known: DataFrame | None,
) -> DataFrame:
    lines = order_lines.filter(
        F.col("entity_code").isin(*units) & F.col("delivery_week").between(*weeks)
    ).withColumnsRenamed({"entity_code": "country", "subscription_id": "fk_subscription"})
    return keep_known(lines, known, SUBSCRIPTION)


def latest_customer(
    order_lines: DataFrame,
    units: Sequence[str],
    weeks: tuple[str, str],
    known: DataFrame | None = None,
) -> DataFrame:
    """Customer of the newest order line per subscription; same-day lines go by customer id.

    ``known`` limits the scan to subscriptions a caller will join anyway.
    """
    newest = Window.partitionBy(*SUBSCRIPTION).orderBy(F.desc("create_date"), "customer_uuid")
    return (
        _order_lines(order_lines, units, weeks, known)
        .select(*SUBSCRIPTION, "customer_uuid", "create_date")
        .withColumn("place", F.row_number().over(newest))
        .filter(F.col("place") == 1)
        .select(*SUBSCRIPTION, "customer_uuid")
    )


def typed_order_lines(
    order_lines: DataFrame,
    units: Sequence[str],
    weeks: tuple[str, str],
    item_type: str,
    known: DataFrame | None = None,
) -> DataFrame:
    """Order lines of one item type in a week range."""
    return (
        _order_lines(order_lines, units, weeks, known)
        .filter(F.col("order_item_type") == item_type)
        .select(*SUBSCRIPTION, "order_line_items_id", "delivery_week")
    )


def cohort_orders(
    members: DataFrame,
    customers: DataFrame,
    order_lines: DataFrame,
    units: Sequence[str],
    weeks: tuple[str, str],
    item_type: str,
) -> DataFrame:
    """Distinct order lines of the members, with their customer."""
    lines = typed_order_lines(order_lines, units, weeks, item_type)
    return (
        members.select(*SUBSCRIPTION)
        .distinct()
        .join(customers, SUBSCRIPTION, "left")
        .join(lines, SUBSCRIPTION)
        .distinct()
    )


def order_rates(
    panel: DataFrame,
    lines: DataFrame,
    ranges: Mapping[str, tuple[str, str]],
    by: Sequence[str] = (),
    box_counts: bool = False,
    per_customer: bool = False,
    salts: int = 1,
) -> DataFrame:
    """Distinct order lines per distinct ordering customer, for each week range.

    ``panel`` has distinct (subscription, cohort, status) rows with the subscription's customer;
    a member counts under every status held. Lines and customers are stacked into one stream of
    ids, each reduced to one row per (cohort, status, id) with one bit per range, so that one
    two-step aggregate with partial sums replaces a distinct count per range and id. The panel's
    own groups join the stream without ids, which keeps groups that never ordered.

    ``box_counts`` adds the lines of each range as ``<range>_BoxCount``; ``per_customer`` divides by
    all customers of the group. With ``salts`` over 1 the lines are first reduced to one row per
    (subscription, line), and a subscription's lines are dealt to that many join partitions, each
    with a copy of its few panel rows: for a join by shuffle in which one subscription may hold a
    large part of all lines.
    """
    group = [*by, "cohort", "status"]
    marks = {name: 1 << place for place, name in enumerate(ranges)}
    mark = sum(
        (
            F.when(F.col("delivery_week").between(*ranges[name]), bit).otherwise(0)
            for name, bit in marks.items()
        ),
        F.lit(0),
    )
    no_line = F.lit(None).cast(lines.schema["order_line_items_id"].dataType)
    no_customer = F.lit(None).cast(panel.schema["customer_uuid"].dataType)
    ids = F.inline(
        F.array(
            F.struct(F.col("order_line_items_id").alias("line"), no_customer.alias("customer")),
            F.struct(no_line.alias("line"), F.col("customer_uuid").alias("customer")),
        )
    )
    marked = lines.select(*SUBSCRIPTION, "order_line_items_id", mark.alias("marks"))
    key, holders = [*SUBSCRIPTION], panel
    if salts > 1:
        marked = marked.groupBy(*SUBSCRIPTION, "order_line_items_id").agg(F.bit_or("marks").alias("marks"))
        marked = marked.withColumn("salt", F.pmod(F.xxhash64("order_line_items_id"), F.lit(salts)))
        holders = panel.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        key.append("salt")
    ordered = holders.join(marked, key).select(*group, "marks", ids)
    groups = panel.select(
        *group, F.lit(0).alias("marks"), no_line.alias("line"), no_customer.alias("customer")
    )
    per_id = (
        ordered.unionByName(groups)
        .groupBy(*group, "line", "customer")
        .agg(F.bit_or("marks").alias("marks"))
    )

    def inside(name: str, kind: str) -> Column:
        return F.count_if((F.col("marks").bitwiseAND(marks[name]) != 0) & F.col(kind).isNotNull())

    customers = F.count("customer")
    boxes = {f"{name}_BoxCount": inside(name, "line") for name in ranges} if box_counts else {}
    rates = {
        name: F.round(F.try_divide(inside(name, "line"), customers if per_customer else inside(name, "customer")), 2)
        for name in ranges
    }
    return per_id.groupBy(*group).agg(
        customers.alias("Total_Customers"), *[value.alias(name) for name, value in {**boxes, **rates}.items()]
    )


def order_rate_deltas(rates: DataFrame, spans: Sequence[str] = ("5W", "10W")) -> DataFrame:
    """Drop from before to after the holiday, per span; positive means fewer orders after."""
    return rates.withColumns(
        {
            f"Delta_{span}": F.round(F.col(f"Pre_{span}") - F.col(f"Post_{span}"), 2)
            for span in spans
        }
    )
