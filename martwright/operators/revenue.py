"""Confirmed revenue and prices. Amounts are added up in whole millionths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.functions.columns import PARTS, dollars, month_start, parts
from martwright.functions.growth import with_year_ago


def _revenue(events: DataFrame | None = None) -> Column:
    cells = events is not None and "revenue_parts" in events.columns
    return F.sum("revenue_parts" if cells else parts("final_net_revenue_usd"))


def revenue_cells(events: DataFrame) -> DataFrame:
    """Invoices and confirmed revenue in millionths per customer, country and month.

    `revenue_monthly`, `revenue_vs_year_ago`, `revenue_by_country` and
    `repeaters.repeater_revenue_share` take these cells in place of events, with the same
    results: whole millionths add up to the same sums in any grouping. Written once, the cells
    make one scan of the events do for all four. `event_date` is the month's first day; events
    other than invoices have no revenue and are pooled under a NULL customer.
    """
    invoice = F.col("event_type") == "invoice"
    return events.groupBy(
        F.when(invoice, F.col("customer_id")).alias("customer_id"),
        "country",
        month_start("event_date").alias("event_date"),
    ).agg(F.count(F.when(invoice, 1)).alias("n_invoices"), _revenue().alias("revenue_parts"))


def revenue_monthly(events: DataFrame) -> DataFrame:
    """Confirmed revenue per month."""
    return (
        events.groupBy(month_start("event_date").alias("year_month"))
        .agg(dollars(_revenue(events)).alias("revenues_monthly"))
        .orderBy(F.col("year_month").asc_nulls_last())
    )


def revenue_vs_year_ago(events: DataFrame) -> DataFrame:
    """Confirmed revenue per year against the year before.

    `growth` compares whole years as far as the data goes. `matched_growth` compares
    only months present in both years, which matters when a year is incomplete.
    """
    monthly = events.groupBy(
        F.year("event_date").cast("int").alias("year"), F.month("event_date").alias("month")
    ).agg(_revenue(events).alias("revenue"))
    matched = with_year_ago(monthly, ["month"], "revenue").where(F.col("revenue_year_ago").isNotNull())
    matched = matched.groupBy("year").agg(
        F.sum("revenue").alias("matched"), F.sum("revenue_year_ago").alias("matched_ago")
    )
    yearly = with_year_ago(monthly.groupBy("year").agg(F.sum("revenue").alias("revenue")), [], "revenue")
    return (
        yearly.join(matched, "year", "left")
        .select(
            "year",
            dollars("revenue").alias("revenue"),
            dollars("revenue_year_ago").alias("revenue_year_ago"),
            _growth("revenue", "revenue_year_ago").alias("growth"),
            dollars("matched").alias("matched_revenue"),
            dollars("matched_ago").alias("matched_revenue_year_ago"),
            _growth("matched", "matched_ago").alias("matched_growth"),
        )
        .orderBy("year")
    )


def _growth(now: str, ago: str) -> Column:
    return F.try_divide(F.col(now).cast("double"), F.col(ago).cast("double")) - 1


def revenue_by_country(events: DataFrame) -> DataFrame:
    """Confirmed revenue per country and year, with the growth over the year before."""
    yearly = events.groupBy("country", F.year("event_date").cast("int").alias("year")).agg(
        _revenue(events).alias("revenue")
    )
    return with_year_ago(yearly, ["country"], "revenue").select(
        "country",
        "year",
        dollars("revenue").alias("revenue"),
        dollars("revenue_year_ago").alias("revenue_year_ago"),
        _growth("revenue", "revenue_year_ago").alias("growth"),
    )


def revenue_per_customer_by_billing(
    events: DataFrame, products: DataFrame, after: str = "2024-12-31"
) -> DataFrame:
    """Confirmed revenue, customers and revenue per customer by billing cycle, after a date."""
    recent = events.where(F.col("event_date") > F.lit(after).cast("date")).select(
        "product_id", "customer_id", "final_net_revenue_usd"
    )
    return (
        recent.join(products.select("product_id", "billing_cycle"), "product_id", "left")
        # One row per customer first: the distinct count then needs no second pass.
        .groupBy("billing_cycle", "customer_id")
        .agg(_revenue().alias("parts"))
        .groupBy("billing_cycle")
        .agg(F.sum("parts").alias("parts"), F.count("customer_id").alias("count_customers"))
        .select(
            "billing_cycle",
            dollars("parts").alias("revenue"),
            "count_customers",
            F.try_divide(dollars("parts"), F.col("count_customers")).alias("revenue_per_customer"),
        )
    )


# The markets and products compared in the pricing report.
PRICED_COUNTRIES = ("United States", "United Kingdom", "Canada")
PRICED_PRODUCTS = ("Azure AI Studio Annual Standard", "Notion AI Annual", "Figma Professional Monthly")


def price_by_product_country(
    events: DataFrame,
    products: DataFrame,
    countries: Sequence[str] = PRICED_COUNTRIES,
    names: Sequence[str] = PRICED_PRODUCTS,
    rows: int = 10,
) -> DataFrame:
    """Average base price over events per product name and country, first `rows` only."""
    sold = (
        events.where(F.col("country").isin(*countries))
        .groupBy("product_id", "country")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    priced = products.where(F.col("product_name").isin(*names)).select(
        "product_id", "product_name", parts("base_price_usd").alias("price")
    )
    price, n = F.col("price"), F.col("n")
    average = F.try_divide(F.sum(n * price), F.sum(F.when(price.isNotNull(), n))) / PARTS
    return (
        sold.join(priced, "product_id")
        .groupBy("product_name", "country")
        .agg(average.alias("average_price"))
        .orderBy("product_name", F.col("average_price").desc_nulls_first(), "country")
        .limit(rows)
    )
