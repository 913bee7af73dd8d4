"""Build the mart, its exports and all reports from three raw tables.

    spark-submit ... -m martwright --events E --customers C --products P --out DIR

Writes under DIR: `mart/` (parquet by year), `customers_final/`, `customer_days/` and `revenue_cells/` (parquet),
`mart_csv/` (CSV by year), `product_pairs/` and `reports/<name>/` (CSV), and the event-sized
results `orders_proceed/`, `orders_not_proceed/`, `invoices_not_orders/`, `events_baskets/`
and `events_baskets_min2/` (parquet).
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from martwright import sinks
from martwright.operators import (
    baskets,
    clean,
    cohorts,
    customers,
    cycles,
    mart,
    quality,
    reconcile,
    refunds,
    repeaters,
    revenue,
)
from martwright.operators.events import customer_days
from martwright.plans.views import write_mart
from martwright.session import builder
from martwright.sources import tables


def reports(
    sold: DataFrame, people: DataFrame, goods: DataFrame, cells: DataFrame | None = None
) -> dict[str, Callable[[], DataFrame]]:
    """Reports by name, from the mart, customers_final and products_final. Revenue reports
    read `cells`, the mart's `revenue_cells`, in place of the mart where given."""
    cells = sold if cells is None else cells
    return {
        "event_id_summary": lambda: quality.event_id_summary(sold),
        "duplicate_event_ids": lambda: quality.duplicate_event_ids(sold),
        "refund_violations": lambda: quality.refund_violations(sold),
        "orphan_keys": lambda: quality.orphan_keys(sold, people, goods),
        "invoices_before_signup": lambda: quality.invoices_before_signup(sold, people),
        "export_chunks": lambda: mart.chunk_counts(sold),
        "order_invoice_counts": lambda: reconcile.order_invoice_counts(sold),
        "refund_counts_monthly": lambda: refunds.refund_counts_monthly(sold),
        "refund_loss_by_category": lambda: refunds.refund_loss_by_category(sold, goods),
        "revenue_monthly": lambda: revenue.revenue_monthly(cells),
        "revenue_vs_year_ago": lambda: revenue.revenue_vs_year_ago(cells),
        "revenue_by_country": lambda: revenue.revenue_by_country(cells),
        "revenue_per_customer_by_billing": lambda: revenue.revenue_per_customer_by_billing(sold, goods),
        "price_by_product_country": lambda: revenue.price_by_product_country(sold, goods),
        "invoice_counts_repeat": lambda: repeaters.invoice_counts_repeat(sold),
        "repeaters_by_month": lambda: repeaters.repeaters_by(sold, people, "year_month", name="repeater"),
        "repeaters_by_acquisition_channel": lambda: repeaters.repeaters_by(
            sold.drop("acquisition_channel"), people, "acquisition_channel"
        ),
        "repeaters_by_sales_channel": lambda: repeaters.repeaters_by(sold, people, "channel"),
        "repeater_revenue_share": lambda: repeaters.repeater_revenue_share(cells, people),
        "repeater_products_by_segment": lambda: repeaters.repeater_products_by_segment(sold, people),
        "repeater_discount_usage": lambda: repeaters.repeater_discount_usage(sold, people),
        "second_purchase_gap": lambda: customers.second_purchase_gap(sold),
        "second_purchase_stats": lambda: cycles.second_purchase_stats(people),
        "purchase_cycle_stats": lambda: cycles.purchase_cycle_stats(sold),
        "revenue_by_cycle_group": lambda: cycles.revenue_by_cycle_group(sold, people),
        "wait_days_distribution": lambda: cycles.wait_days_distribution(sold, people),
        "attachment_rate": lambda: baskets.attachment_rate(sold, goods),
        "retention_from_signup": lambda: cohorts.retention_from_signup(sold, people),
        "retention_calendar": lambda: cohorts.retention_calendar(sold, people),
    }


def raw_reports(
    events_raw: DataFrame, customers_raw: DataFrame, products_raw: DataFrame
) -> dict[str, Callable[[], DataFrame]]:
    """Reports by name on the tables as given."""
    raw = {"events_raw": events_raw, "customers_raw": customers_raw, "products_raw": products_raw}
    return {
        "blank_profile": lambda: reduce(
            DataFrame.unionByName, [quality.blank_profile(df, name) for name, df in raw.items()]
        ),
        "foreign_font_values": lambda: quality.foreign_font_values(products_raw),
        "dimension_keys": lambda: quality.dimension_keys(customers_raw, "customers_raw", "customer_id").unionByName(
            quality.dimension_keys(products_raw, "products_raw", "product_id")
        ),
    }


def large_results(sold: DataFrame, goods: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """Results with a row per event, match or basket row, by name."""
    return {
        "orders_proceed": lambda: reconcile.orders_proceed(sold),
        "orders_not_proceed": lambda: reconcile.orders_not_proceed(sold),
        "invoices_not_orders": lambda: reconcile.invoices_not_orders(sold),
        "events_baskets": lambda: baskets.events_baskets(sold, goods),
        "events_baskets_min2": lambda: baskets.events_baskets_min2(baskets.events_baskets(sold, goods)),
    }


def build(
    events_raw: DataFrame, customers_raw: DataFrame, products_raw: DataFrame, out: str, mode: str = "errorifexists"
) -> None:
    """Write everything. The mart and the customers are read back, so each report scans
    finished tables and a lost executor never causes the mart to be joined again."""
    spark = events_raw.sparkSession
    events = clean.events_clean(events_raw)
    goods = clean.products_final(products_raw)

    final = customers.customers_final(clean.customers_clean(customers_raw), events)
    final.write.mode(mode).parquet(f"{out}/customers_final")
    people = spark.read.schema(final.schema).parquet(f"{out}/customers_final")

    days = customer_days(events)
    days.write.mode(mode).parquet(f"{out}/customer_days")
    days = spark.read.schema(days.schema).parquet(f"{out}/customer_days")
    joined = mart.combined_whole(events_raw, people, goods, days)
    write_mart(joined, f"{out}/mart", mode)
    sold = spark.read.schema(joined.schema).parquet(f"{out}/mart").select(*joined.columns)

    sinks.export_chunks(sold, f"{out}/mart_csv", mode=mode)
    sinks.export_product_pairs(
        baskets.product_pairs(baskets.basket_rows(sold), goods), f"{out}/product_pairs", mode
    )
    for name, result in large_results(sold, goods).items():
        result().write.mode(mode).parquet(f"{out}/{name}")
    summed = revenue.revenue_cells(sold)
    summed.write.mode(mode).parquet(f"{out}/revenue_cells")
    cells = spark.read.schema(summed.schema).parquet(f"{out}/revenue_cells")
    every_report = reports(sold, people, goods, cells) | raw_reports(events_raw, customers_raw, products_raw)
    for name, report in every_report.items():
        sinks.write_csv(report(), f"{out}/reports/{name}", mode)


_READERS = {"events": tables.read_events, "customers": tables.read_customers, "products": tables.read_products}
_READERS_WITH_REJECTS = {
    "events": lambda spark, path: tables.read_with_rejects(spark, path, tables.EVENTS),
    "customers": tables.read_customers_with_rejects,
    "products": lambda spark, path: tables.read_with_rejects(spark, path, tables.PRODUCTS),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="martwright", description=__doc__.splitlines()[0])
    for table in ("events", "customers", "products"):
        parser.add_argument(f"--{table}", required=True, help=f"path of {table}_raw")
    parser.add_argument("--out", required=True, help="directory to write to")
    parser.add_argument("--format", default="parquet", help="format of the raw tables: parquet or csv")
    parser.add_argument("--mode", default="errorifexists", choices=["errorifexists", "overwrite"])
    parser.add_argument(
        "--keep-rejects",
        action="store_true",
        help="CSV only: write lines that do not fit their table to OUT/rejects and go on without them",
    )
    args = parser.parse_args(argv)
    if args.keep_rejects and args.format != "csv":
        parser.error("--keep-rejects is for --format csv")

    spark = builder("martwright").getOrCreate()
    raw = {}
    for name, path in {"events": args.events, "customers": args.customers, "products": args.products}.items():
        if args.keep_rejects:
            raw[name], rejects = _READERS_WITH_REJECTS[name](spark, path)
            rejects.write.mode(args.mode).parquet(f"{args.out}/rejects/{name}")
            written = spark.read.schema(rejects.schema).parquet(f"{args.out}/rejects/{name}")
            sinks.write_csv(tables.rejects_by_reason(written), f"{args.out}/reports/rejects_{name}", args.mode)
        else:
            raw[name] = _READERS[name](spark, path, args.format)
    build(raw["events"], raw["customers"], raw["products"], args.out, args.mode)


if __name__ == "__main__":
    main()
