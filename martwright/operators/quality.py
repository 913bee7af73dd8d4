"""Data quality checks on the raw and cleaned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.functions.columns import is_blank, month_start
from martwright.operators.clean import ADDON, ADDON_PATTERN

NON_ASCII = r"[^\x00-\x7F]"


def duplicate_event_ids(events: DataFrame) -> DataFrame:
    """Event ids that occur more than once."""
    return events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def event_id_summary(events: DataFrame) -> DataFrame:
    """One row: events, distinct ids, ids used more than once."""
    per_id = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("event_rows"),
        F.count("event_id").alias("distinct_ids"),
        F.count(F.when(F.col("n") > 1, 1)).alias("repeated_ids"),
    )


def refund_audit(events: DataFrame, rows: int = 50) -> DataFrame:
    """A sample of refunded events, whose confirmed revenue should be 0."""
    return (
        events.where("is_refunded")
        .orderBy("event_id", "unit_price_local")
        .limit(rows)
        .select("net_revenue_usd", "is_refunded", "event_type", "final_net_revenue_usd")
    )


def refund_violations(events: DataFrame) -> DataFrame:
    """Per event type: refunded rows, and rows with revenue that must have none."""
    must_be_zero = F.col("is_refunded") | (F.col("event_type") == "order")
    return events.groupBy("event_type").agg(
        F.count(F.when(F.col("is_refunded"), 1)).alias("refunded_rows"),
        F.count(F.when(must_be_zero & (F.col("final_net_revenue_usd") != 0), 1)).alias("violations"),
    )


def orphan_keys(events: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Foreign keys of events with no row in the table they point to.

    Events are counted per key first, so each anti join sees a key once. A NULL key
    breaks no foreign key and is not an orphan.
    """

    def orphans(table: str, key: str, dimension: DataFrame) -> DataFrame:
        used = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return used.join(dimension.select(key), key, "left_anti").agg(
            F.lit(table).alias("dependency_table"),
            F.lit(key).alias("key_column"),
            F.count(F.lit(1)).alias("orphan_keys"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_events"),
        )

    return orphans("customers_raw", "customer_id", customers).unionByName(
        orphans("products_raw", "product_id", products)
    )


def dimension_keys(dimension: DataFrame, table: str, key: str) -> DataFrame:
    """One row: rows of a dimension table, distinct keys, keys used more than once.

    A repeated key makes the mart repeat events; a NULL key counts as a key only when repeated.
    """
    per_key = dimension.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.lit(table).alias("table_name"),
        F.lit(key).alias("key_column"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count(key).alias("distinct_keys"),
        F.count(F.when(F.col("n") > 1, 1)).alias("repeated_keys"),
    )


def blank_profile(df: DataFrame, table: str) -> DataFrame:
    """Rows that are NULL, or empty for text, per column: one aggregate over the table."""

    def blanks(field: T.StructField):
        c = F.col(field.name)
        return is_blank(c) if isinstance(field.dataType, T.StringType) else c.isNull()

    counts = [F.count(F.when(blanks(f), 1)).alias(f.name) for f in df.schema.fields]
    return (
        df.agg(F.count(F.lit(1)).alias("__rows"), *counts)
        .unpivot(["__rows"], df.columns, "column_name", "blank_rows")
        .select(F.lit(table).alias("table_name"), "column_name", F.col("__rows").alias("total_rows"), "blank_rows")
    )


def foreign_font_values(products: DataFrame) -> DataFrame:
    """Product names with non-ASCII characters or a first 'Add-on' spelled otherwise."""
    name = F.col("product_name")
    found = F.regexp_extract(name, f"(?s){ADDON_PATTERN}", 0)
    return products.select(
        "product_id",
        "product_name",
        name.rlike(NON_ASCII).alias("non_ascii"),
        ((found != "") & (found != ADDON)).alias("addon_variant"),
    ).where("non_ascii OR addon_variant")


def invoices_before_signup(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Invoices dated before their customer signed up, per signup month."""
    per_day = (
        events.where(F.col("event_type") == "invoice")
        .groupBy("customer_id", "event_date")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    signup = F.col("signup_date").cast("date")
    early = per_day.join(
        customers.select("customer_id", signup.alias("signup_date")), "customer_id"
    ).where(F.col("event_date") < F.col("signup_date"))
    return (
        early.groupBy("customer_id", month_start("signup_date").alias("signup_year_month"))
        .agg(F.sum("n").alias("n"))
        .groupBy("signup_year_month")
        .agg(F.sum("n").alias("invoices"), F.count("customer_id").alias("customers"))
        .orderBy("signup_year_month")
    )
