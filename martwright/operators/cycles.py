"""Purchase cycles: how long customers wait, and what that is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.functions.columns import PARTS, parts, round_half_away


def _stats(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        *[
            round_half_away(f(F.col(column)), 2).alias(f"{label}_{column}")
            for label, f in (("avg", F.avg), ("min", F.min), ("max", F.max))
        ]
    )


def second_purchase_stats(customers_final: DataFrame) -> DataFrame:
    """Average, least and most wait days over customers."""
    return _stats(customers_final, "wait_days")


def purchase_cycle_stats(events_final: DataFrame) -> DataFrame:
    """Average, least and most days since the last invoice over all events."""
    return _stats(events_final, "days_since_last_invoice")


def _repeater_revenue(events: DataFrame, customers_final: DataFrame) -> DataFrame:
    """Repeaters with their total invoiced revenue in millionths."""
    spent = (
        events.where(F.col("event_type") == "invoice")
        .groupBy("customer_id")
        .agg(F.sum(parts("final_net_revenue_usd")).alias("parts"))
    )
    waits = customers_final.where("is_repeater").select("customer_id", "wait_days")
    return waits.join(spent, "customer_id")


def _average_dollars() -> Column:
    return F.sum("parts") / F.count("parts") / PARTS


def revenue_by_cycle_group(events: DataFrame, customers_final: DataFrame, cycles=(1, 2, 3, 4)) -> DataFrame:
    """Average revenue of repeaters by wait group; 'Other' takes 0, longer and unknown waits."""
    group = F.when(F.col("wait_days").isin(*cycles), F.concat(F.col("wait_days").cast("string"), F.lit("-day cycle")))
    return (
        _repeater_revenue(events, customers_final)
        .groupBy(group.otherwise("Other").alias("cycle_group"))
        .agg(_average_dollars().alias("avg_revenue"))
    )


def wait_days_distribution(events: DataFrame, customers_final: DataFrame) -> DataFrame:
    """Repeaters and their average revenue per wait, unknown waits last."""
    return (
        _repeater_revenue(events, customers_final)
        .groupBy("wait_days")
        .agg(F.count(F.lit(1)).alias("customer_count"), _average_dollars().alias("avg_revenue"))
        .orderBy(F.col("wait_days").asc_nulls_last())
    )
