"""Retention of signup cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martwright.functions.columns import calendar_months_between, month_start, round_half_away


def _active_months(events: DataFrame) -> DataFrame:
    """Months in which each customer was invoiced: one row per customer and month."""
    return (
        events.where((F.col("event_type") == "invoice") & F.col("customer_id").isNotNull())
        .select("customer_id", month_start("event_date").alias("event_month"))
        .distinct()
    )


def _signups(customers: DataFrame) -> DataFrame:
    return customers.where(F.col("signup_year_month").isNotNull()).select("customer_id", "signup_year_month")


def _months_since_signup():
    return calendar_months_between("signup_year_month", "event_month")


def retention_from_signup(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Active customers by months since signup, in percent of those active in month 0.

    Invoices before the signup month are left out, and so are cohorts with nobody active
    in month 0. Rates can pass 100. Signup months start on the 1st, so completed and
    calendar months agree, and working on distinct months loses nothing.
    """
    activity = (
        _active_months(events)
        .join(_signups(customers), "customer_id")
        .where(F.col("event_month") >= F.col("signup_year_month"))
        .groupBy("signup_year_month", _months_since_signup().alias("months_since_signup"))
        .agg(F.count(F.lit(1)).alias("active"))
    )
    at_start = F.max(F.when(F.col("months_since_signup") == 0, F.col("active")))
    return (
        activity.withColumn("cohort_size", at_start.over(Window.partitionBy("signup_year_month")))
        .where(F.col("cohort_size").isNotNull())
        .select(
            "signup_year_month",
            "months_since_signup",
            round_half_away(F.lit(100.0) * F.col("active") / F.col("cohort_size"), 1).alias("retention_rate_pct"),
        )
        .orderBy("signup_year_month", "months_since_signup")
    )


def retention_calendar(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Active customers by calendar months since signup, in percent of the cohort's invoiced customers.

    Invoices before signup count, under negative months. Each customer is counted into
    the cohort size in its first active month, so the size is a sum over the activity
    rows and needs no second pass.
    """
    first = F.min("event_month").over(Window.partitionBy("customer_id"))
    activity = (
        _active_months(events)
        .withColumn("is_first", F.col("event_month").eqNullSafe(first))
        .join(_signups(customers), "customer_id")
        .groupBy("signup_year_month", _months_since_signup().alias("months_since_signup"))
        .agg(F.count(F.lit(1)).alias("active"), F.count(F.when(F.col("is_first"), 1)).alias("joined"))
    )
    size = F.sum("joined").over(Window.partitionBy("signup_year_month"))
    return activity.select(
        "signup_year_month",
        "months_since_signup",
        (F.col("active") * F.lit(100.0) / size).alias("retention_rate_pct"),
    ).orderBy("signup_year_month", "months_since_signup")
