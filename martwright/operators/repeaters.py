"""What repeat customers do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.functions.columns import dollars, month_start, parts, round_half_away
from martwright.functions.joins import splittable_join
from martwright.operators.customers import by_customer, flag_repeaters, repeating_customers

SEGMENTS = ("Consumer", "SOHO", "SMB", "Enterprise")


def repeaters_by(events: DataFrame, customers: DataFrame, key: str, name: str = "repeaters") -> DataFrame:
    """Distinct repeaters per value of an event or customer column, most first; months in order.

    Values without repeaters are listed with 0, events of unknown customers under NULL.
    """
    order = [F.col(key).asc_nulls_last()]
    if key != "year_month":
        order.insert(0, F.col(name).desc())
    of_event = key in events.columns
    grouped = by_customer(events, [key] if of_event else [])
    flagged = flag_repeaters(grouped, customers, *([] if of_event else [key]))
    repeaters = F.count(F.when(F.col("is_repeater"), F.col("customer_id"))).alias(name)
    return flagged.groupBy(key).agg(repeaters).orderBy(*order)


def repeater_revenue_share(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Monthly confirmed revenue, the part from repeaters, and its share in percent.

    Orders carry no revenue and only keep their month in the result, so they are pooled
    under a NULL customer before the grouping: what is shuffled per customer is
    invoices alone. `revenue.revenue_cells` of the events will do as well.
    """
    if "revenue_parts" in events.columns:
        pooled, revenue = events.withColumn("year_month", F.col("event_date")), F.sum("revenue_parts")
    else:
        pooled = events.select(
            F.when(F.col("event_type") == "invoice", F.col("customer_id")).alias("customer_id"),
            "event_type",
            month_start("event_date").alias("year_month"),
            "final_net_revenue_usd",
        )
        revenue = F.sum(parts("final_net_revenue_usd"))
    monthly = by_customer(pooled, ["year_month"], revenue.alias("revenue"))
    total, repeat = F.col("total"), F.col("repeat")
    return (
        flag_repeaters(monthly, customers)
        .groupBy("year_month")
        .agg(
            F.sum("revenue").alias("total"),
            F.sum(F.when(F.col("is_repeater"), F.col("revenue")).otherwise(0)).alias("repeat"),
        )
        .select(
            "year_month",
            dollars(total).alias("total_revenue"),
            dollars(repeat).alias("revenue_repeater"),
            round_half_away(repeat * F.lit(100.0) / F.nullif(total, F.lit(0)), 2).alias("pct_revenue_repeater"),
        )
        .orderBy(F.col("year_month").asc_nulls_last())
    )


def repeater_products_by_segment(
    events: DataFrame, customers: DataFrame, segments: Sequence[str] = SEGMENTS
) -> DataFrame:
    """Events of repeaters per product, counted in one column per segment.

    Products can be as many as a large customer's events, so nothing is grouped per
    customer: events are joined to the repeaters and then counted, with map-side combine.
    """
    counts = [
        F.count(F.when(F.col("segment") == s, F.col("product_id"))).alias(f"products_{s.lower()}_repeater")
        for s in segments
    ]
    buyers = repeating_customers(customers, events, "segment")
    sold = splittable_join(events.select("customer_id", "product_id"), buyers, "customer_id")
    return sold.groupBy("product_id").agg(*counts).orderBy(F.col("product_id").asc_nulls_last())


def repeater_discount_usage(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Events (not customers) of repeaters per discount group, most first.

    Codes are free text, so a large customer can have any number of them: no window runs
    over a customer's codes. Events are counted per customer and code, spread by both;
    invoices per customer are added up from these counts, map side first; and the counts
    join the repeaters in a join that splits a hot customer.
    """
    # Invoices are a key and not a second count: both readers below then need the same
    # columns of the grouping, and Spark shuffles the events once for the two.
    used = (
        events.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "discount_group", (F.col("event_type") == "invoice").alias("invoice"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    invoices = F.sum(F.when(F.col("invoice"), F.col("n")).otherwise(0)).alias("invoices")
    twice = used.groupBy("customer_id").agg(invoices).where("invoices >= 2")
    buyers = customers.select("customer_id").join(twice, "customer_id", "left_semi")
    return (
        splittable_join(used, buyers, "customer_id")
        .groupBy("discount_group")
        .agg(F.sum("n").alias("repeaters_count"))
        .orderBy(F.col("repeaters_count").desc(), F.col("discount_group").asc_nulls_last())
    )


def invoice_counts_repeat(events: DataFrame) -> DataFrame:
    """Customers with more than one invoice, and how many they have, most first.

    The id in the sort spreads the many customers with equal counts over the range
    partitions.
    """
    return (
        events.where(F.col("event_type") == "invoice")
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("invoice_count"))
        .where("invoice_count > 1")
        .orderBy(F.col("invoice_count").desc(), F.col("customer_id").asc_nulls_last())
    )
