from conftest import day
from martwright.operators import reconcile
from martwright.sources import testdata


def deals(make_events):
    return make_events(
        dict(event_type="order", event_date="2024-05-01"),
        dict(event_type="invoice", event_date="2024-04-01"),
        dict(event_type="invoice", event_date="2024-05-11"),
        dict(event_type="order", quantity=2),
        dict(event_type="invoice", quantity=3),
        dict(event_type="order", quantity=4, is_refunded=None),
        dict(event_type="invoice", quantity=4, is_refunded=None),
    )


def test_matches_multiply_and_ignore_dates(make_events, rows):
    got = reconcile.orders_proceed(deals(make_events))
    assert rows(got, "order_date", "invoice_date", "invoice_lag_days") == [
        (day("2024-05-01"), day("2024-04-01"), -30), (day("2024-05-01"), day("2024-05-11"), 10),
    ]


def test_null_keys_never_match(make_events, rows):
    events = deals(make_events)
    assert rows(reconcile.orders_not_proceed(events), "quantity") == [(2,), (4,)]
    assert rows(reconcile.invoices_not_orders(events), "quantity") == [(3,), (4,)]


def expected_counts(events):
    parts = {f: getattr(reconcile, f)(events).count() for f in ("orders_proceed", "orders_not_proceed", "invoices_not_orders")}
    return sorted(parts.items())


def test_counts_without_joins_equal_the_joins(make_events, rows, spark, sf_dir):
    events = deals(make_events)
    assert rows(reconcile.order_invoice_counts(events)) == expected_counts(events)
    empty = events.limit(0)
    assert rows(reconcile.order_invoice_counts(empty)) == expected_counts(empty)
    real = testdata.events_raw(spark, sf_dir, geography=False)
    assert rows(reconcile.order_invoice_counts(real)) == expected_counts(real)


def test_orders_split_into_matched_and_unmatched(spark, sf_dir):
    events = testdata.events_raw(spark, sf_dir, geography=False)
    matched = events.where("event_type = 'order'").join(
        events.where("event_type = 'invoice'").select(*reconcile.MATCH_KEYS), list(reconcile.MATCH_KEYS), "left_semi"
    )
    unmatched = reconcile.orders_not_proceed(events)
    assert matched.count() + unmatched.count() == events.where("event_type = 'order'").count()


def test_small_amounts_are_not_lost(spark):
    from martwright.operators import revenue

    events = spark.range(1000).selectExpr("date '2024-01-01' AS event_date", "0.004D AS final_net_revenue_usd")
    assert revenue.revenue_monthly(events).first()["revenues_monthly"] == 4.0
