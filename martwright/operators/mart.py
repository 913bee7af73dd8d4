"""The mart: every event with its timing, customer and product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.functions.packing import packed_through
from martwright.operators.clean import PRODUCT_COLUMNS, events_clean_after, with_signup_month
from martwright.operators.events import attach_dates, customer_days, gaps

CUSTOMER_COLUMNS = (
    "signup_date",
    "region_customers",
    "currency_preference",
    "segment",
    "acquisition_channel",
    "age_band",
    "country_customers",
    "country_latitude_customers",
    "country_longitude_customers",
    "second_purchase_date",
    "wait_days",
    "is_repeater",
    "signup_year_month",
)

#: What sorts customers into groups: few different rows, however many customers.
PROFILE_COLUMNS = (
    "region_customers",
    "currency_preference",
    "segment",
    "acquisition_channel",
    "age_band",
    "country_customers",
    "country_latitude_customers",
    "country_longitude_customers",
)

#: Texts of events that the mart's joins do not read.
EVENT_TEXTS = ("channel", "discount_code", "event_type", "region", "country")

NARROW_FIRST = ("boolean", "int", "date", "bigint", "double")

TIMING_COLUMNS = ("last_invoice_date", "next_invoice_date", "days_since_last_invoice", "days_to_next_invoice")


def _profile() -> Column:
    """A profile's number, 64 bits of hash. Hashing skips nulls, so each is marked."""
    return F.xxhash64(*[part for c in PROFILE_COLUMNS for part in (F.col(c), F.col(c).isNull())])


def _by_type(df: DataFrame) -> list[str]:
    """Columns with flags and small numbers side by side and texts last: a shuffle's compression
    then finds longer runs of zeros."""
    types = dict(df.dtypes)
    return sorted(df.columns, key=lambda c: NARROW_FIRST.index(types[c]) if types[c] in NARROW_FIRST else len(NARROW_FIRST))


def combined(
    events: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    columns: Sequence[str] | None = None,
    days: DataFrame | None = None,
    unique_keys: bool = False,
) -> DataFrame:
    """events_clean joined with customers_final and products_final, one row per event.

    Customer attributes are joined to the customer-days rather than to the events: both
    are partitioned by customer already, a customer has at most one row per day there,
    and the events are then shuffled once, by customer and day, for timing and
    attributes together.

    What the shuffle by product carries is kept narrow: of the customer's profile only its
    number, whose few different rows are joined last, and none of the columns that others give,
    the days between dates and the customer's id.

    `columns` restricts the output. With `unique_keys`, the caller's word that no customer
    or product id repeats in its table (`quality.dimension_keys` tells), joins that the
    columns do not need are left out: they neither add nor drop events then, which Spark
    cannot know. `days` is as for `events_final`.
    """
    customer_side = ["customer_id_c", *CUSTOMER_COLUMNS]
    product_side = ["product_id_p", *PRODUCT_COLUMNS[1:]]
    everything = [*events.columns, *TIMING_COLUMNS, *customer_side, *product_side]
    wanted = list(columns) if columns is not None else everything
    unknown = set(wanted) - set(everything)
    if unknown:
        raise ValueError(f"columns not in the mart: {sorted(unknown)}")

    mart = events
    needed = set(wanted) if unique_keys else set(everything)
    made = {}
    if needed & {*TIMING_COLUMNS, *customer_side}:
        days = customer_days(events) if days is None else days
        if needed & set(customer_side):
            own = [c for c in CUSTOMER_COLUMNS if c not in PROFILE_COLUMNS]
            attributes = customers.select(
                F.col("customer_id").alias("customer_id_c"), *own, _profile().alias("__profile")
            )
            days = days.join(attributes, F.col("day_customer_id") == F.col("customer_id_c"), "left")
            if events.schema["customer_id"].dataType == customers.schema["customer_id"].dataType:
                days = days.withColumn("__known", F.col("customer_id_c").isNotNull()).drop("customer_id_c")
                made["customer_id_c"] = F.when(F.col("__known"), F.col("customer_id")).alias("customer_id_c")
        mart = attach_dates(events, days)
        made |= dict(zip(TIMING_COLUMNS[2:], gaps(), strict=True))
    if needed & set(product_side):
        catalog = products.select(F.col("product_id").alias("product_id_p"), *PRODUCT_COLUMNS[1:])
        mart = mart.select(*_by_type(mart))
        mart = mart.join(catalog, F.col("product_id") == F.col("product_id_p"), "left")
    if set(wanted) & set(PROFILE_COLUMNS):
        profiles = customers.select(_profile().alias("__number"), *PROFILE_COLUMNS).distinct()
        mart = mart.join(profiles, F.col("__profile") == F.col("__number"), "left")
    return mart.select(*[made.get(c, c) for c in wanted])


def combined_whole(
    events_raw: DataFrame, customers: DataFrame, products: DataFrame, days: DataFrame
) -> DataFrame:
    """`combined(events_clean(events_raw), …)` for a mart that is read or written with all its
    columns, from `customers_clean`'s signup month and `customer_days` of the same events.

    Both shuffles of the events carry their texts as one column, and what cleaning derives,
    the signup month too, is made after them.
    """

    def attach(events: DataFrame) -> DataFrame:
        return with_signup_month(combined(events, customers, products, days=days))

    return events_clean_after(events_raw, lambda raw: packed_through(raw, EVENT_TEXTS, attach))


def chunk_counts(mart: DataFrame, date: str = "event_date") -> DataFrame:
    """Rows per export chunk (calendar year)."""
    return (
        mart.groupBy(F.year(date).cast("int").alias("chunk_year"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.col("chunk_year").asc_nulls_last())
    )
