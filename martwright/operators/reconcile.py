"""Matching orders to invoices on everything but the date."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.functions.membership import key_map, with_possible_partner

# An order and an invoice with the same values here are taken as one deal. There is no
# date condition: an invoice may come before its order. A NULL never matches.
MATCH_KEYS = ("customer_id", "product_id", "quantity", "unit_price_local", "net_revenue_usd", "is_refunded")


def _of_type(events: DataFrame, event_type: str, keys: Sequence[str], date: str) -> DataFrame:
    return events.where(F.col("event_type") == event_type).select(*keys, F.col("event_date").alias(date))


def orders_proceed(events: DataFrame, keys: Sequence[str] = MATCH_KEYS) -> DataFrame:
    """Orders with a matching invoice, one row per matching pair."""
    orders = _of_type(events, "order", keys, "order_date")
    invoices = _of_type(events, "invoice", keys, "invoice_date").where(F.col("invoice_date").isNotNull())
    return orders.join(invoices, list(keys)).select(
        *keys[:2],
        "order_date",
        "invoice_date",
        *keys[2:],
        F.datediff("invoice_date", "order_date").alias("invoice_lag_days"),
    )


def _unmatched(events, kept, other, keys, date, bits):
    left = _of_type(events, kept, keys, date)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    # One row per key, combined map side: a key that is hot on the right stays one row. Null-safe
    # equality hashes keys in another way than the grouping did, so both inputs get a
    # shuffle of their own and AQE can split a hot key on the left.
    right = events.where(F.col("event_type") == other).where(whole)
    right = right.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    if bits:
        # Rows whose key has no bit on the right are results already and move nowhere.
        left = with_possible_partner(left, keys, key_map(right, right.columns, bits), "__partner", bits)
        doubtful = whole & F.col("__partner")
    else:
        doubtful = whole
    # An anti join, not a left join filtered on NULL, which Spark would run as written.
    unmatched = left.where(doubtful).join(right, same, "left_anti")
    return unmatched.unionByName(left.where(~doubtful)).select(*keys[:2], date, *keys[2:])


def orders_not_proceed(events: DataFrame, keys: Sequence[str] = MATCH_KEYS, bits: int = 0) -> DataFrame:
    """Orders without a matching invoice. Event dates must not be NULL.

    With `bits` (`membership.BITS`, say) only orders that may have a partner by a bit map of
    the invoices' hashed keys are shuffled and compared. That changes the cost and not the
    result: the share of partnerless orders that is shuffled nevertheless is the share of
    bits set, about the number of different keys divided by `bits`. It pays where moving
    rows costs more than looking them up, so on one machine it does not.
    """
    return _unmatched(events, "order", "invoice", keys, "order_date", bits)


def invoices_not_orders(events: DataFrame, keys: Sequence[str] = MATCH_KEYS, bits: int = 0) -> DataFrame:
    """Invoices without a matching order, as `orders_not_proceed` the other way round."""
    return _unmatched(events, "invoice", "order", keys, "invoice_date", bits)


def order_invoice_counts(events: DataFrame, keys: Sequence[str] = MATCH_KEYS) -> DataFrame:
    """Row counts of the three results above.

    They follow from the number of orders and invoices per match key: one grouping with
    map-side combine instead of three joins, and no matching pair is ever built.
    """
    n_orders, n_invoices = F.col("n_orders"), F.col("n_invoices")
    per_key = events.groupBy(*keys).agg(
        F.count(F.when(F.col("event_type") == "order", 1)).alias("n_orders"),
        F.count(F.when(F.col("event_type") == "invoice", 1)).alias("n_invoices"),
    )
    matchable = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])

    def total(amount):
        return F.coalesce(F.sum(amount), F.lit(0))

    counts = {
        "orders_not_proceed": total(F.when(matchable & (n_invoices > 0), 0).otherwise(n_orders)),
        "invoices_not_orders": total(F.when(matchable & (n_orders > 0), 0).otherwise(n_invoices)),
        "orders_proceed": total(F.when(matchable, n_orders * n_invoices).otherwise(0)),
    }
    return per_key.agg(*[c.alias(name) for name, c in counts.items()]).unpivot(
        [], list(counts), "category", "cnt"
    )
