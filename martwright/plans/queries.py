"""Registered queries: every operator on the provided tables, whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from martwright.operators import (
    baskets,
    clean,
    cohorts,
    customers,
    cycles,
    events,
    mart,
    quality,
    reconcile,
    refunds,
    repeaters,
    revenue,
)
from martwright.sources import testdata


class Inputs:
    """The raw and cleaned tables a query may ask for, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str, whole_lines: bool = False):
        self.spark, self.sf_dir, self.whole_lines = spark, sf_dir, whole_lines

    @property
    def in_one_shuffle(self) -> Inputs:
        """The same tables for a query that reads the events several times: one shuffle of the lines."""
        return Inputs(self.spark, self.sf_dir, whole_lines=True)

    @property
    def events_raw(self) -> DataFrame:
        return testdata.events_raw(self.spark, self.sf_dir, whole_lines=self.whole_lines)

    @property
    def sales(self) -> DataFrame:
        """Raw events without region and country, for queries that read neither."""
        return testdata.events_raw(self.spark, self.sf_dir, geography=False, whole_lines=self.whole_lines)

    @property
    def revenue(self) -> DataFrame:
        return clean.with_final_revenue(self.sales)

    @property
    def events(self) -> DataFrame:
        return clean.events_clean(self.events_raw)

    @property
    def days(self) -> DataFrame:
        return events.customer_days(self.sales)

    @property
    def customers_raw(self) -> DataFrame:
        return testdata.customers_raw(self.spark, self.sf_dir)

    @property
    def customers(self) -> DataFrame:
        return clean.customers_clean(self.customers_raw)

    @property
    def customers_final(self) -> DataFrame:
        return customers.customers_final(self.customers, self.sales)

    @property
    def products_raw(self) -> DataFrame:
        return testdata.products_raw(self.spark, self.sf_dir)

    @property
    def products(self) -> DataFrame:
        return clean.products_final(self.products_raw)

    @property
    def baskets(self) -> DataFrame:
        return baskets.events_baskets(self.sales, self.products)


def _blank_profile(t: Inputs) -> DataFrame:
    tables = {"events_raw": t.events_raw, "customers_raw": t.customers_raw, "products_raw": t.products_raw}
    profiles = [quality.blank_profile(df, name) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, profiles)


def _dimension_keys(t: Inputs) -> DataFrame:
    return quality.dimension_keys(t.customers_raw, "customers_raw", "customer_id").unionByName(
        quality.dimension_keys(t.products_raw, "products_raw", "product_id")
    )


def _chunk_counts(t: Inputs) -> DataFrame:
    # Both keys are primary keys of the provided tables; `dimension_keys` shows it.
    sold = mart.combined(t.sales, t.customers_final, t.products, columns=["event_date"], unique_keys=True)
    return mart.chunk_counts(sold)


def _combined(t: Inputs) -> DataFrame:
    return mart.combined_whole(t.events_raw, t.customers_final, t.products, t.days)


BASKET_ORDER = ("basket_id", "product_id")

_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    # Exports
    "mart_export_chunks": _chunk_counts,
    # Data quality
    "duplicate_event_ids": lambda t: quality.duplicate_event_ids(t.sales),
    "event_id_summary": lambda t: quality.event_id_summary(t.sales),
    "refund_audit": lambda t: quality.refund_audit(t.revenue),
    "refund_violations": lambda t: quality.refund_violations(t.revenue),
    "orphan_keys": lambda t: quality.orphan_keys(t.sales, t.customers_raw, t.products_raw),
    "dimension_keys": _dimension_keys,
    "blank_profile": _blank_profile,
    "foreign_font_values": lambda t: quality.foreign_font_values(t.products_raw),
    "invoices_before_signup": lambda t: quality.invoices_before_signup(t.sales, t.customers_raw),
    # Cleaning and the mart
    "events_clean": lambda t: t.events,
    "customers_clean": lambda t: t.customers,
    "products_final": lambda t: t.products,
    "events_final": lambda t: clean.events_clean_after(t.events_raw, lambda e: events.events_final(e, days=t.days)),
    "customers_final": lambda t: t.customers_final,
    "combined": lambda t: _combined(t.in_one_shuffle),
    # Orders against invoices
    "orders_proceed": lambda t: reconcile.orders_proceed(t.sales),
    "orders_not_proceed": lambda t: reconcile.orders_not_proceed(t.sales),
    "invoices_not_orders": lambda t: reconcile.invoices_not_orders(t.sales),
    "order_invoice_counts": lambda t: reconcile.order_invoice_counts(t.sales),
    # Revenue and refunds
    "refund_counts_monthly": lambda t: refunds.refund_counts_monthly(t.sales),
    "revenue_monthly": lambda t: revenue.revenue_monthly(t.revenue),
    "revenue_vs_year_ago": lambda t: revenue.revenue_vs_year_ago(t.revenue),
    "revenue_by_country": lambda t: revenue.revenue_by_country(t.events),
    "revenue_per_customer_by_billing": lambda t: revenue.revenue_per_customer_by_billing(t.revenue, t.products),
    "price_by_product_country": lambda t: revenue.price_by_product_country(t.events_raw, t.products),
    "refund_loss_by_category": lambda t: refunds.refund_loss_by_category(t.sales, t.products),
    # Repeat customers
    "invoice_counts_repeat": lambda t: repeaters.invoice_counts_repeat(t.sales),
    "repeaters_by_month": lambda t: repeaters.repeaters_by(
        clean.with_year_month(t.sales), t.customers, "year_month", name="repeater"
    ),
    "repeaters_by_acquisition_channel": lambda t: repeaters.repeaters_by(
        t.sales, t.customers, "acquisition_channel"
    ),
    "repeaters_by_sales_channel": lambda t: repeaters.repeaters_by(t.sales, t.customers, "channel"),
    "repeater_revenue_share": lambda t: repeaters.repeater_revenue_share(t.revenue, t.customers),
    "repeater_products_by_segment": lambda t: repeaters.repeater_products_by_segment(t.sales, t.customers),
    "repeater_discount_usage": lambda t: repeaters.repeater_discount_usage(
        clean.with_discount_group(t.sales), t.customers
    ),
    # Purchase cycles
    "second_purchase_gap": lambda t: customers.second_purchase_gap(t.sales),
    "second_purchase_stats": lambda t: cycles.second_purchase_stats(t.customers_final),
    "purchase_cycle_stats": lambda t: cycles.purchase_cycle_stats(events.events_final(t.sales)),
    "revenue_by_cycle_group": lambda t: cycles.revenue_by_cycle_group(t.revenue, t.customers_final),
    "wait_days_distribution": lambda t: cycles.wait_days_distribution(t.revenue, t.customers_final),
    # Baskets
    "events_baskets": lambda t: t.baskets,
    "events_baskets_preview": lambda t: baskets.preview(t.baskets, BASKET_ORDER),
    "events_baskets_min2": lambda t: baskets.events_baskets_min2(t.baskets),
    "events_baskets_min2_preview": lambda t: baskets.preview(baskets.events_baskets_min2(t.baskets), BASKET_ORDER),
    "product_pairs": lambda t: baskets.product_pairs(baskets.basket_rows(t.sales), t.products),
    "attachment_rate": lambda t: baskets.attachment_rate(t.sales, t.products),
    # Cohorts
    "retention_from_signup": lambda t: cohorts.retention_from_signup(t.sales, t.customers),
    "retention_calendar": lambda t: cohorts.retention_calendar(t.sales, t.customers),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(build):
        return lambda spark, sf_dir: build(Inputs(spark, sf_dir))

    return {name: run(build) for name, build in _QUERIES.items()}
