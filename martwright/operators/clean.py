"""Cleaning and derived columns: narrow projections only, nothing here shuffles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.functions.columns import is_blank, month_start, replace_first

NORTH_AMERICA = ("United States", "Canada")


def fill_blank_region(
    df: DataFrame,
    region: str = "region",
    country: str = "country",
    countries: Sequence[str] = NORTH_AMERICA,
    fill: str = "NAm",
) -> DataFrame:
    """Fill a NULL or empty region for the given countries; other blanks stay.

    The code 'NA' for North America is read as a missing value by many import tools.
    """
    blank_here = is_blank(region) & F.col(country).isin(*countries)
    return df.withColumn(region, F.when(blank_here, fill).otherwise(F.col(region)))


def with_discount_group(events: DataFrame, none_code: str = "N/A", label: str = "Full Price") -> DataFrame:
    """Discount code with the 'no discount' code spelled out; NULL stays NULL."""
    code = F.col("discount_code")
    return events.withColumn("discount_group", F.when(code == none_code, label).otherwise(code))


def with_year_month(events: DataFrame) -> DataFrame:
    return events.withColumn("year_month", month_start("event_date"))


def is_confirmed() -> Column:
    """An invoice known not to be refunded: the only source of revenue.

    False rather than NULL when the refund flag is missing.
    """
    return (F.col("event_type") == "invoice") & F.col("is_refunded").eqNullSafe(False)


def with_final_revenue(events: DataFrame) -> DataFrame:
    """Confirmed revenue: 0 for orders and for refunded invoices."""
    return events.withColumn(
        "final_net_revenue_usd", F.when(is_confirmed(), F.col("net_revenue_usd")).otherwise(F.lit(0.0))
    )


def events_clean(events_raw: DataFrame) -> DataFrame:
    """events_raw with regions filled, discount group, month and confirmed revenue."""
    filled = fill_blank_region(events_raw)
    return with_final_revenue(with_year_month(with_discount_group(filled)))


def events_clean_after(events_raw: DataFrame, attach: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`attach(events_clean(events_raw))`, with the same columns in the same order, for an
    `attach` that only adds columns to the events and reads none that cleaning makes or fills.

    The derived columns are made of columns at hand, so they are made after the shuffles
    of `attach` and not carried through them.
    """
    attached = attach(events_raw)
    cleaned = events_clean(attached)
    derived = [c for c in cleaned.columns if c not in attached.columns]
    added = [c for c in attached.columns if c not in events_raw.columns]
    return cleaned.select(*events_raw.columns, *derived, *added)


def rename_geography(customers: DataFrame, suffix: str = "_customers") -> DataFrame:
    """Rename the customer columns that events carry too, ahead of the mart join."""
    return customers.withColumnsRenamed({c: c + suffix for c in ("region", "country") if c in customers.columns})


def customers_clean(customers_raw: DataFrame) -> DataFrame:
    """customers_raw with regions filled and the signup month."""
    return with_signup_month(fill_blank_region(customers_raw, "region_customers", "country_customers"))


def with_signup_month(customers: DataFrame) -> DataFrame:
    return customers.withColumn("signup_year_month", month_start(F.col("signup_date").cast("date")))


PRODUCT_COLUMNS = (
    "product_id",
    "product_name",
    "category",
    "is_subscription",
    "billing_cycle",
    "base_price_usd",
    "first_release_date",
    "vendor",
    "resale_model",
    "brand_safe_name",
    "product_name_orig",
    "base_price_usd_orig",
    "base_key",
    "product_version",
)

ADDON_PATTERN = "Add.?on"
ADDON = "Add-on"


def products_final(products_raw: DataFrame) -> DataFrame:
    """Products with the broken hyphen of the first 'Add-on' in the name repaired."""
    repaired = replace_first("product_name", ADDON_PATTERN, ADDON).alias("product_name")
    return products_raw.select(*[repaired if c == "product_name" else c for c in PRODUCT_COLUMNS])
