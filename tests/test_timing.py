"""Invoice timing and second purchases against a row-by-row computation."""


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import day
from martwright.operators.clean import customers_clean
from martwright.operators.customers import customers_final, second_purchase_gap
from martwright.operators.events import events_final

FAR = day("9999-12-31")


def order_key(e):
    return (e["event_date"] is None, e["event_date"] or FAR, e["event_id"], e["unit_price_local"])


def confirmed(e):
    return e["event_type"] == "invoice" and e["is_refunded"] is False


def by_customer(events):
    groups = {}
    for e in sorted(events, key=order_key):
        groups.setdefault(e["customer_id"], []).append(e)
    return groups


def days(a, b):
    return (a - b).days if a and b else None


def expected_timing(events):
    out = []
    for group in by_customer(events).values():
        for i, e in enumerate(group):
            last = max((x["event_date"] for x in group[: i + 1] if confirmed(x) and x["event_date"]), default=None)
            following = min((x["event_date"] for x in group[i:] if confirmed(x) and x["event_date"]), default=None)
            d = e["event_date"]
            out.append((e["event_id"], e["unit_price_local"], last, following, days(d, last), days(following, d)))
    return sorted(out, key=repr)


def expected_second(events):
    out = {}
    for customer, group in by_customer(events).items():
        invoices = [e for e in group if e["event_type"] == "invoice"]
        if customer is None or len(invoices) < 2:
            continue
        first, second = invoices[:2]
        last = max((e["event_date"] for e in (first, second) if confirmed(e)), default=None)
        out[customer] = (first["event_date"], second["event_date"], days(second["event_date"], last))
    return out


TIMING = ("event_id", "unit_price_local", "last_invoice_date", "next_invoice_date", "days_since_last_invoice", "days_to_next_invoice")

event = st.fixed_dictionaries(
    {
        "customer_id": st.sampled_from(["C1", "C1", "C1", "C2", None]),
        "event_date": st.sampled_from([day(f"2024-01-{d:02}") for d in range(1, 6)]),
        "event_type": st.sampled_from(["invoice", "invoice", "order"]),
        "is_refunded": st.sampled_from([True, False, False, None]),
        "event_id": st.sampled_from([f"E{n}" for n in range(12)]),
    }
)


def numbered(events):
    # Ids repeat on purpose; the price then decides, as in the operators' tie order.
    return [{**e, "unit_price_local": float(n)} for n, e in enumerate(events)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(event, min_size=1, max_size=30).map(numbered))
def test_timing_and_second_purchase_on_random_events(make_events, make_customers, rows, events):
    df = make_events(*events)
    assert rows(events_final(df), *TIMING) == expected_timing(events)
    second = expected_second(events)
    gaps = rows(second_purchase_gap(df), "customer_id", "first_purchase_date", "second_purchase_date", "gap_days")
    assert gaps == sorted(((c, a, b, days(b, a)) for c, (a, b, _) in second.items()), key=repr)
    customers = customers_clean(make_customers(*({"customer_id": c} for c in ("C1", "C2", "C3"))))
    final = rows(customers_final(customers, df), "customer_id", "second_purchase_date", "wait_days", "is_repeater")
    assert final == sorted(
        ((c, *second[c][1:], True) if c in second else (c, None, None, False) for c in ("C1", "C2", "C3")), key=repr
    )


def test_missing_dates_come_last(make_events, rows):
    events = numbered(
        [
            {"event_id": "E1", "event_date": day("2024-01-03")},
            {"event_id": "E2", "event_date": None},
            {"event_id": "E3", "event_date": None, "event_type": "order"},
            {"event_id": "E0", "event_date": day("2024-01-01"), "event_type": "order"},
        ]
    )
    full = [{"customer_id": "C1", "event_type": "invoice", "is_refunded": False, **e} for e in events]
    assert rows(events_final(make_events(*full)), *TIMING) == expected_timing(full)


def test_wait_days_counts_the_second_invoice_itself(make_events, make_customers, rows):
    """0 when the second invoice stands, even days later; the gap operator has the true distance."""
    stands = [dict(event_date="2024-01-01"), dict(event_date="2024-01-09")]
    refunded = [dict(event_date="2024-01-01"), dict(event_date="2024-01-09", is_refunded=True)]
    none_left = [dict(event_date="2024-01-01", is_refunded=True), dict(event_date="2024-01-09", is_refunded=True)]
    same_day = [dict(event_date="2024-01-01"), dict(event_date="2024-01-01"), dict(event_date="2024-02-01", is_refunded=True)]
    cases = {"C1": stands, "C2": refunded, "C3": none_left, "C4": same_day, "C5": stands[:1]}
    events = make_events(*({**e, "customer_id": c} for c, es in cases.items() for e in es))
    customers = customers_clean(make_customers(*({"customer_id": c} for c in cases)))
    got = {r.customer_id: r for r in customers_final(customers, events).collect()}
    assert {c: (r.wait_days, r.is_repeater) for c, r in got.items()} == {
        "C1": (0, True), "C2": (8, True), "C3": (None, True), "C4": (0, True), "C5": (None, False),
    }
    gaps = dict(rows(second_purchase_gap(events), "customer_id", "gap_days"))
    assert gaps == {"C1": 8, "C2": 8, "C3": 8, "C4": 0}


def test_a_confirmed_invoice_is_zero_days_from_itself(spark, sf_dir):
    from martwright.sources import testdata

    timed = events_final(testdata.events_raw(spark, sf_dir, geography=False))
    bad = timed.where("event_type = 'invoice' AND NOT is_refunded").where(
        "days_since_last_invoice <> 0 OR days_to_next_invoice <> 0"
    )
    assert bad.count() == 0
