"""Invoice timing per event: the nearest confirmed invoice before and after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.operators.clean import is_confirmed

# Within one day events have no natural order; these columns make it total.
SAME_DAY_ORDER = ("event_id", "unit_price_local")

DAY_COLUMNS = ("first_confirmed", "last_confirmed", "previous_invoice_day", "next_invoice_day")


def _position(order: Sequence[str]) -> Column:
    return F.struct(*order)


def customer_days(events: DataFrame, order: Sequence[str] = SAME_DAY_ORDER) -> DataFrame:
    """One row per customer and day that has any event.

    `first_confirmed` / `last_confirmed` are the positions within the day of its first
    and last confirmed invoice; `previous_invoice_day` / `next_invoice_day` are the
    nearest other days with one. The grouping is combined map side, and the windows
    then see at most one row per calendar day, however many events a customer has.

    The second window runs backwards in time instead of using an unbounded-following
    frame, which Spark re-evaluates from scratch for every row.
    """
    # Projected first: the aggregate sorts its input, which then carries no position for
    # most rows and none of the columns it is made from.
    placed = events.select(
        F.col("customer_id").alias("day_customer_id"),
        F.col("event_date").alias("day_date"),
        F.when(is_confirmed(), _position(order)).alias("position"),
    )
    days = placed.groupBy("day_customer_id", "day_date").agg(
        F.min("position").alias("first_confirmed"), F.max("position").alias("last_confirmed")
    )
    invoice_day = F.when(F.col("first_confirmed").isNotNull(), F.col("day_date"))
    customer = Window.partitionBy("day_customer_id")
    before = customer.orderBy(F.col("day_date").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = customer.orderBy(F.col("day_date").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return days.select(
        "*",
        F.max(invoice_day).over(before).alias("previous_invoice_day"),
        F.min(invoice_day).over(after).alias("next_invoice_day"),
    )


def attach_dates(events: DataFrame, days: DataFrame, order: Sequence[str] = SAME_DAY_ORDER) -> DataFrame:
    """Join `customer_days` (and whatever was joined to it) back to the events, which get the
    last and the next invoice date and no days between.

    The key is customer and day, so the events of a busy customer spread over as many
    partitions as the customer has days, and both inputs have a shuffle of their own,
    which lets AQE split a single oversized day as well. NULL keys match each other.
    """
    extra = [c for c in days.columns if c not in ("day_customer_id", "day_date", *DAY_COLUMNS)]
    joined = events.join(
        days,
        events["customer_id"].eqNullSafe(days["day_customer_id"])
        & events["event_date"].eqNullSafe(days["day_date"]),
        "left",
    )
    position, date = _position(order), F.col("event_date")
    last = F.coalesce(F.when(position >= F.col("first_confirmed"), date), F.col("previous_invoice_day"))
    following = F.coalesce(F.when(position <= F.col("last_confirmed"), date), F.col("next_invoice_day"))
    return joined.select(
        *events.columns, last.alias("last_invoice_date"), following.alias("next_invoice_date"), *extra
    )


def gaps() -> list[Column]:
    """Days since the last invoice and to the next one, from the dates."""
    return [
        F.datediff("event_date", "last_invoice_date").alias("days_since_last_invoice"),
        F.datediff("next_invoice_date", "event_date").alias("days_to_next_invoice"),
    ]


def attach_days(events: DataFrame, days: DataFrame, order: Sequence[str] = SAME_DAY_ORDER) -> DataFrame:
    """`attach_dates` with the days since the last invoice and to the next one."""
    dated = attach_dates(events, days, order)
    known = [*events.columns, "last_invoice_date", "next_invoice_date"]
    return dated.select(*known, *gaps(), *[c for c in dated.columns if c not in known])


def events_final(
    events: DataFrame, order: Sequence[str] = SAME_DAY_ORDER, days: DataFrame | None = None
) -> DataFrame:
    """Events plus the last confirmed invoice up to each and the next one from it on.

    Both include the event itself, so a confirmed invoice is 0 days from either. This
    is a running max and min over the customer's events ordered by date and
    `order`, without putting all events of a customer into one window task.

    `days` is `customer_days` of the same events where it is at hand already, read from a
    table or computed from a narrower source.
    """
    return attach_days(events, customer_days(events, order) if days is None else days, order)
