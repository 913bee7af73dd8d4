"""Customers with their second purchase."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martwright.operators.clean import is_confirmed
from martwright.operators.events import SAME_DAY_ORDER


def _invoices_in_order(order: Sequence[str]):
    by_date = Window.partitionBy("customer_id").orderBy(F.col("event_date").asc_nulls_last(), *order)
    return by_date, by_date.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def second_purchases(events: DataFrame, order: Sequence[str] = SAME_DAY_ORDER) -> DataFrame:
    """The second invoice of each customer, refunded or not.

    `wait_days` is the event's days since the last confirmed invoice, itself included:
    0 when it is confirmed itself, NULL when neither of the first two is. Only the
    first two invoices bear on it, so the full event timing is not computed, and
    Spark's window group limit keeps two rows per customer and map task before the
    shuffle. That needs every window expression to use an expanding frame.
    """
    by_date, so_far = _invoices_in_order(order)
    return (
        events.where((F.col("event_type") == "invoice") & F.col("customer_id").isNotNull())
        .select(
            "customer_id",
            F.col("event_date").alias("second_purchase_date"),
            F.max(F.when(is_confirmed(), F.col("event_date"))).over(so_far).alias("last_confirmed_date"),
            F.row_number().over(by_date).alias("rownum"),
        )
        .where(F.col("rownum") == 2)
        .select(
            "customer_id",
            "second_purchase_date",
            F.datediff("second_purchase_date", "last_confirmed_date").alias("wait_days"),
        )
    )


def second_purchase_gap(events: DataFrame, order: Sequence[str] = SAME_DAY_ORDER) -> DataFrame:
    """True days from each customer's first invoice to the second."""
    by_date, so_far = _invoices_in_order(order)
    return (
        events.where((F.col("event_type") == "invoice") & F.col("customer_id").isNotNull())
        .select(
            "customer_id",
            F.min("event_date").over(so_far).alias("first_purchase_date"),
            F.col("event_date").alias("second_purchase_date"),
            F.row_number().over(by_date).alias("rownum"),
        )
        .where(F.col("rownum") == 2)
        .select(
            "customer_id",
            "first_purchase_date",
            "second_purchase_date",
            F.datediff("second_purchase_date", "first_purchase_date").alias("gap_days"),
        )
    )


def customers_final(
    customers: DataFrame, events: DataFrame, order: Sequence[str] = SAME_DAY_ORDER
) -> DataFrame:
    """`customers_clean` plus second purchase date, wait days and the repeater flag.

    Customers without a second invoice stay, with NULLs and `is_repeater` false.
    """
    second = second_purchases(events, order).withColumn("is_repeater", F.lit(True))
    own = [c for c in customers.columns if c != "signup_year_month"]
    return customers.join(second, "customer_id", "left").select(
        *own,
        "second_purchase_date",
        "wait_days",
        F.coalesce("is_repeater", F.lit(False)).alias("is_repeater"),
        "signup_year_month",
    )


def repeating_customers(customers: DataFrame, events: DataFrame, *attributes: str) -> DataFrame:
    """Ids and attributes of repeaters: known customers with at least two invoices."""
    twice = (
        events.where(F.col("event_type") == "invoice")
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n >= 2")
    )
    return customers.select("customer_id", *attributes).join(twice, "customer_id", "left_semi")


def by_customer(events: DataFrame, keys: Sequence[str], *measures) -> DataFrame:
    """Pre-aggregate events to one row per customer and `keys`, with `two_invoices`.

    `two_invoices` tells whether the customer has at least two invoices over all keys,
    which is what makes a known customer a repeater. Reading it off the same
    aggregate avoids a second pass over the events, and it is why `events` must be all
    events of a customer, not a selection by date (or groups of them with `n_invoices`). After the (map-side combined)
    grouping the rows of a customer are bounded by the number of key values. The keys
    must have few values (months, channels): then the window and any later join on the
    customer are safe for very large customers.
    """
    counted = "n_invoices" in events.columns
    invoices = F.sum("n_invoices") if counted else F.count(F.when(F.col("event_type") == "invoice", 1))
    grouped = events.groupBy("customer_id", *keys).agg(invoices.alias("n_invoices"), *measures)
    total = F.sum("n_invoices").over(Window.partitionBy("customer_id")) if keys else F.col("n_invoices")
    return grouped.withColumn("two_invoices", total >= 2).drop("n_invoices")


def flag_repeaters(grouped: DataFrame, customers: DataFrame, *attributes: str) -> DataFrame:
    """Left join customer attributes to `by_customer` rows and resolve `is_repeater`.

    Only customers present in the customer table can be repeaters.
    """
    known = customers.select("customer_id", *attributes, F.lit(True).alias("known"))
    return grouped.join(known, "customer_id", "left").withColumn(
        "is_repeater", F.coalesce("known", F.lit(False)) & F.col("two_invoices")
    )
