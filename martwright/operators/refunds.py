"""Refunds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.functions.columns import dollars, month_start, parts


def refund_counts_monthly(events: DataFrame) -> DataFrame:
    """Refunded events per month, orders included."""
    return (
        events.where("is_refunded")
        .groupBy(month_start("event_date").alias("year_month"), "is_refunded")
        .agg(F.count("event_id").alias("count_refunds"))
        .orderBy(F.col("year_month").asc_nulls_last())
    )


def refund_loss_by_category(events: DataFrame, products: DataFrame) -> DataFrame:
    """Invoiced revenue lost to refunds per product category and year."""
    lost = (
        events.where((F.col("event_type") == "invoice") & F.col("is_refunded"))
        .groupBy("product_id", F.year("event_date").cast("int").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(parts("net_revenue_usd")).alias("parts"))
    )
    return (
        lost.join(products.select("product_id", "category"), "product_id", "left")
        .groupBy("category", "year")
        .agg(F.sum("n").alias("refunded_invoices"), dollars(F.sum("parts")).alias("refund_loss_usd"))
    )
