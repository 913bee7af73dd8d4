"""The analysis layer as temporary views, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from martwright.operators import baskets, clean, customers, events, mart, reconcile
from martwright.sinks import export_chunks


def build_views(events_raw: DataFrame, customers_raw: DataFrame, products_raw: DataFrame) -> dict[str, DataFrame]:
    """Every view of the analysis layer by name, lazily, from the three raw tables."""
    clean_events = clean.events_clean(events_raw)
    final_customers = customers.customers_final(clean.customers_clean(customers_raw), clean_events)
    final_products = clean.products_final(products_raw)
    final_events = clean.events_clean_after(events_raw, events.events_final)
    basket_view = baskets.events_baskets(clean_events, final_products)
    return {
        "events_final": final_events,
        "events_final_new": final_events,
        "customers_final": final_customers,
        "products_final": final_products,
        "combined": clean.events_clean_after(
            events_raw, lambda raw: mart.combined(raw, final_customers, final_products)
        ),
        "orders_proceed": reconcile.orders_proceed(clean_events),
        "orders_not_proceed": reconcile.orders_not_proceed(clean_events),
        "invoices_not_orders": reconcile.invoices_not_orders(clean_events),
        "events_baskets": basket_view,
        "events_baskets_min2": baskets.events_baskets_min2(basket_view),
        "product_pairs": baskets.product_pairs(basket_view, final_products),
    }


def register_views(
    events_raw: DataFrame, customers_raw: DataFrame, products_raw: DataFrame, mart_path: str | None = None
) -> dict[str, DataFrame]:
    """Register the views for `spark.sql`.

    With `mart_path`, `combined` reads the mart written there (see `write_mart`), so
    repeated reports scan one table instead of joining everything each time.
    """
    views = build_views(events_raw, customers_raw, products_raw)
    if mart_path is not None:
        columns = views["combined"].schema
        views["combined"] = events_raw.sparkSession.read.schema(columns).parquet(mart_path).select(*columns.names)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def write_mart(mart_df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the mart as parquet, partitioned by year.

    Each file holds one year, so date filters skip files by their row group statistics
    even where they do not name the partition column.
    """
    export_chunks(mart_df, path, grain="year", format="parquet", mode=mode)
