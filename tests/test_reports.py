"""Reports: fixed small cases, and reconciliation between reports on the test tables."""

import pytest
from pyspark.sql import functions as F

from conftest import day
from martwright.operators import baskets, clean, cohorts, customers, cycles, mart, refunds, repeaters, revenue
from martwright.operators.events import customer_days
from martwright.plans.queries import Inputs, queries


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return Inputs(spark, sf_dir)


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    registered = queries()
    return lambda name: registered[name](spark, sf_dir).collect()


def test_share_is_null_without_revenue(make_events, make_customers, rows):
    events = clean.with_final_revenue(
        make_events(
            dict(event_type="order", event_date="2024-01-05"),
            dict(event_date="2024-02-05", net_revenue_usd=30.0), dict(event_date="2024-02-06", net_revenue_usd=30.0),
            dict(event_date="2024-02-07", customer_id="C2", net_revenue_usd=30.0),
            dict(event_date="2024-03-07", customer_id="C9", net_revenue_usd=1.0),
            dict(event_date="2024-03-08", customer_id="C9", net_revenue_usd=1.0),
            dict(event_date="2024-03-08", customer_id=None, net_revenue_usd=1.0),
            dict(event_date="2024-03-08", customer_id=None, net_revenue_usd=1.0),
        )
    )
    got = rows(repeaters.repeater_revenue_share(events, make_customers(dict(), dict())))
    assert got == [
        (day("2024-01-01"), 0.0, 0.0, None), (day("2024-02-01"), 90.0, 60.0, 66.67), (day("2024-03-01"), 4.0, 0.0, 0.0),
    ]


def test_one_pass_repeaters_agree_with_the_mart(tables, rows):
    """Reports that pre-aggregate give what a plain query on the joined mart gives."""
    joined = mart.combined(tables.events, tables.customers_final, tables.products)
    joined.createOrReplaceTempView("mart_for_test")
    sql = joined.sparkSession.sql
    cases = [
        (
            repeaters.repeaters_by(clean.with_year_month(tables.sales), tables.customers, "year_month"),
            """SELECT year_month, count(DISTINCT CASE WHEN is_repeater THEN customer_id END) AS repeaters
               FROM mart_for_test GROUP BY year_month""",
        ),
        (
            repeaters.repeaters_by(tables.sales, tables.customers, "acquisition_channel"),
            """SELECT acquisition_channel, count(DISTINCT CASE WHEN is_repeater THEN customer_id END) AS repeaters
               FROM mart_for_test GROUP BY acquisition_channel""",
        ),
        (
            repeaters.repeater_discount_usage(clean.with_discount_group(tables.sales), tables.customers),
            """SELECT discount_group, count(customer_id) AS repeaters_count
               FROM mart_for_test WHERE is_repeater GROUP BY discount_group""",
        ),
        (
            cohorts.retention_calendar(tables.sales, tables.customers).select("signup_year_month", "months_since_signup"),
            """SELECT DISTINCT signup_year_month,
                 (year(event_date) - year(signup_year_month)) * 12 + month(event_date) - month(signup_year_month) AS m
               FROM mart_for_test WHERE event_type = 'invoice' AND signup_year_month IS NOT NULL""",
        ),
    ]
    for operator, statement in cases:
        assert rows(operator) == rows(sql(statement))


def test_mart_keeps_every_event_once(tables):
    joined = mart.combined(tables.events, tables.customers_final, tables.products)
    assert joined.count() == tables.sales.count()
    assert joined.columns[:16] == tables.events.columns
    assert len(joined.columns) == 16 + 4 + 14 + 14


def test_mart_has_each_customers_own_profile(make_events, make_customers, make_products):
    """Nulls in different columns, repeated and missing ids, equal and different profiles."""
    own = [
        dict(customer_id="C1", region_customers="A", segment=None),
        dict(customer_id="C2", region_customers=None, segment="A"),
        dict(customer_id="C3", region_customers="A", segment=None, signup_date=None),
        dict(customer_id="C4", segment=None, acquisition_channel=None),
        dict(customer_id="C4", segment="", acquisition_channel="Email"),
        dict(customer_id=None, segment="none"),
    ]
    events = make_events(*[dict(customer_id=c) for c in ("C1", "C2", "C3", "C4", "C5", None)])
    people = customers.customers_final(make_customers(*own).withColumn("signup_year_month", F.lit(None).cast("date")), events)
    for cleaned in (mart.combined(clean.events_clean(events), people, clean.products_final(make_products(dict()))),
                    clean.events_clean_after(events, lambda e: mart.combined(e, people, clean.products_final(make_products(dict()))))):
        got = cleaned.select("customer_id", "customer_id_c", "region_customers", "segment", "acquisition_channel", "signup_date")
        before, after = day("2023-12-15"), None
        assert sorted(map(tuple, got.collect()), key=repr) == sorted([
            ("C1", "C1", "A", None, "Email", before), ("C2", "C2", None, "A", "Email", before), ("C3", "C3", "A", None, "Email", after),
            ("C4", "C4", None, None, None, before), ("C4", "C4", None, "", "Email", before),
            ("C5", None, None, None, None, None), (None, None, None, None, None, None),
        ], key=repr)
        assert cleaned.columns == mart.combined(clean.events_clean(events), people, clean.products_final(make_products(dict()))).columns


def test_whole_mart_is_the_mart(make_events, make_customers, make_products, rows):
    """Texts that hold what separates and marks packed ones, repeated and missing keys."""
    odd = ["", " ", "a\x1fb", "\x1b", "\x1ba", "\x1b\x1fb\x1b", "\x1f", None, "Größe", "N/A", "Canada"]
    events = make_events(
        *[dict(customer_id=f"C{n % 3}", channel=t, region=odd[-n], country=odd[n - 5], discount_code=odd[n - 3],
               event_type=None if t == "" else "invoice") for n, t in enumerate(odd)],
        dict(customer_id=None, product_id="P2", event_date=None), dict(event_id="E1", customer_id="C9", product_id=None),
    )
    events = events.unionByName(events.limit(3))
    people = clean.customers_clean(make_customers(
        dict(customer_id="C1"), dict(customer_id="C1", signup_date="2024-02-03"), dict(customer_id="C2", signup_date=None),
    ))
    people = customers.customers_final(people, events)
    goods = clean.products_final(make_products(dict(product_id="P1"), dict(product_id="P1"), dict(product_id=None)))
    whole = mart.combined_whole(events, people, goods, customer_days(events))
    plain = mart.combined(clean.events_clean(events), people, goods)
    assert [(f.name, f.dataType) for f in whole.schema] == [(f.name, f.dataType) for f in plain.schema]
    assert rows(whole) == rows(plain) and len(rows(plain)) > events.count()


def test_mart_subset_skips_joins(tables, rows):
    some = ["event_id", "unit_price_local", "days_since_last_invoice", "category"]
    args = (tables.events, tables.customers_final, tables.products)
    assert rows(mart.combined(*args, columns=some, unique_keys=True)) == rows(mart.combined(*args), *some)
    plan = mart.combined(*args, columns=["event_id"], unique_keys=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "part.parquet" not in plan
    with pytest.raises(ValueError):
        mart.combined(*args, columns=["nope"])


def test_mart_subset_has_the_rows_of_the_mart(tables):
    twice = tables.customers_final.unionByName(tables.customers_final.orderBy("customer_id").limit(3))
    args = (tables.events, twice, tables.products)
    n = mart.combined(*args).count()
    assert n > tables.sales.count()
    assert mart.combined(*args, columns=["event_date"]).count() == n


def test_chunks_add_up(run, tables):
    assert sum(r.row_count for r in run("mart_export_chunks")) == tables.sales.count()


def test_yearly_revenue_adds_up(run):
    monthly = run("revenue_monthly")
    yearly = {r.year: r.revenue for r in run("revenue_vs_year_ago")}
    for year, total in yearly.items():
        assert round(sum(r.revenues_monthly for r in monthly if r.year_month.year == year), 2) == pytest.approx(total)
    by_country = run("revenue_by_country")
    assert sum(r.revenue for r in by_country) == pytest.approx(sum(yearly.values()))
    share = {r.year_month: r.total_revenue for r in run("repeater_revenue_share")}
    assert share == {r.year_month: r.revenues_monthly for r in monthly}


def test_repeater_events_add_up(run):
    by_segment = run("repeater_products_by_segment")
    events = sum(sum(v for k, v in r.asDict().items() if k != "product_id") for r in by_segment)
    assert events == sum(r.repeaters_count for r in run("repeater_discount_usage"))


def test_wait_distribution_covers_all_repeaters(run):
    repeaters_total = sum(r.is_repeater for r in run("customers_final"))
    assert sum(r.customer_count for r in run("wait_days_distribution")) == repeaters_total


def test_cycle_groups(make_events, make_customers, rows):
    def customer(c, gap):
        return [
            dict(customer_id=c, event_date="2024-01-01", net_revenue_usd=10.0),
            dict(customer_id=c, event_date=f"2024-01-{1 + gap:02}", is_refunded=True),
        ]

    events = clean.with_final_revenue(
        make_events(*customer("C1", 1), *customer("C2", 4), *customer("C3", 5), *customer("C4", 4), dict(customer_id="C5"))
    )
    people = clean.customers_clean(make_customers(*({"customer_id": f"C{n}"} for n in range(1, 7))))
    final = customers.customers_final(people, events)
    assert rows(cycles.revenue_by_cycle_group(events, final)) == [
        ("1-day cycle", 10.0), ("4-day cycle", 10.0), ("Other", 10.0),
    ]
    assert rows(cycles.wait_days_distribution(events, final)) == [(1, 1, 10.0), (4, 2, 10.0), (5, 1, 10.0)]
    assert rows(cycles.second_purchase_stats(final)) == [(3.5, 1.0, 5.0)]


def test_stats_of_nothing_are_null(make_events, make_customers, rows):
    final = customers.customers_final(clean.customers_clean(make_customers(dict())), make_events(dict()))
    assert rows(cycles.second_purchase_stats(final)) == [(None, None, None)]


def test_billing_date_bound_is_exclusive_and_customers_distinct(make_events, make_products, rows):
    events = clean.with_final_revenue(
        make_events(
            dict(event_date="2024-12-31"), dict(event_date="2025-01-01"), dict(event_date="2025-01-02"),
            dict(event_date="2025-01-02", customer_id="C2", net_revenue_usd=5.0),
            dict(event_date="2025-01-02", customer_id=None, product_id="P9"),
        )
    )
    got = rows(revenue.revenue_per_customer_by_billing(events, make_products(dict())))
    assert got == [("Annual", 25.0, 2, 12.5), (None, 10.0, 0, None)]


def test_average_price_weighs_events(make_events, make_products, rows):
    products = make_products(
        dict(product_name="Notion AI Annual", base_price_usd=10.0), dict(product_name="Notion AI Annual", base_price_usd=40.0),
        dict(product_name="Figma Professional Monthly", base_price_usd=None), dict(product_name="Elsewhere"),
    )
    events = make_events(
        *[dict(country="Canada", product_id=p) for p in ("P1", "P1", "P2", "P3", "P4")], dict(country="Germany"),
    )
    assert rows(revenue.price_by_product_country(events, products)) == [
        ("Figma Professional Monthly", "Canada", None), ("Notion AI Annual", "Canada", 20.0),
    ]


def test_year_ago_matches_months(make_events, rows):
    events = clean.with_final_revenue(
        make_events(
            dict(event_date="2023-05-01", net_revenue_usd=100.0), dict(event_date="2023-06-01", net_revenue_usd=50.0),
            dict(event_date="2024-05-01", net_revenue_usd=150.0), dict(event_date="2024-07-01", net_revenue_usd=30.0),
        )
    )
    got = rows(revenue.revenue_vs_year_ago(events))
    assert got == [
        (2023, 150.0, None, None, None, None, None),
        (2024, 180.0, 150.0, pytest.approx(0.2), 150.0, 100.0, 0.5),
    ]


def test_refunds(make_events, make_products, rows):
    events = make_events(
        dict(is_refunded=True, event_type="order"), dict(is_refunded=True, event_date="2024-01-31", net_revenue_usd=7.25),
        dict(is_refunded=True, event_date="2025-01-01", product_id="P9"), dict(),
    )
    assert rows(refunds.refund_counts_monthly(events)) == [(day("2024-01-01"), True, 2), (day("2025-01-01"), True, 1)]
    assert rows(refunds.refund_loss_by_category(events, make_products(dict()))) == [("Tools", 2024, 1, 7.25), (None, 2025, 1, 10.0)]


def test_invoice_counts(make_events, rows):
    events = make_events(dict(), dict(is_refunded=True), dict(customer_id="C2"), dict(customer_id="C2", event_type="order"))
    assert rows(repeaters.invoice_counts_repeat(events)) == [("C1", 2)]


def test_retention(make_events, make_customers, rows):
    people = clean.customers_clean(
        make_customers(
            dict(signup_date="2024-01-31"), dict(signup_date="2024-01-02"), dict(signup_date="2024-03-01"), dict(signup_date=None)
        )
    )
    events = make_events(
        dict(customer_id="C1", event_date="2024-01-05"), dict(customer_id="C1", event_date="2024-01-06"),
        dict(customer_id="C1", event_date="2024-02-06"), dict(customer_id="C2", event_date="2024-02-29"),
        dict(customer_id="C2", event_date="2023-12-31"), dict(customer_id="C3", event_date="2024-05-01"),
        dict(customer_id="C4"), dict(customer_id=None), dict(customer_id="C3", event_date="2024-03-01", event_type="order"),
    )
    jan, mar = day("2024-01-01"), day("2024-03-01")
    assert rows(cohorts.retention_from_signup(events, people)) == [(jan, 0, 100.0), (jan, 1, 200.0)]
    assert rows(cohorts.retention_calendar(events, people)) == sorted(
        [(jan, -1, 50.0), (jan, 0, 50.0), (jan, 1, 100.0), (mar, 2, 100.0)], key=repr
    )


def test_attachment(make_events, make_products, rows):
    products = make_products(dict(product_name="Plan"), dict(product_name="X Add-on"), dict(product_name=None))
    events = make_events(
        dict(), dict(product_id="P2"), dict(product_id="P1", customer_id="C2"), dict(product_id="P3", customer_id="C3"),
        dict(product_id="P2", customer_id="C4", event_date="2024-02-01"),
    )
    assert rows(baskets.attachment_rate(events, products)) == [
        (day("2024-01-01"), 1, 2, 0.5), (day("2024-02-01"), 1, 0, None),
    ]


def test_report_order(run):
    """NULL keys last in ascending order; counts descending."""
    waits = [r.wait_days for r in run("wait_days_distribution")]
    assert waits[-1] is None and waits[:-1] == sorted(waits[:-1])
    for name, column in (
        ("repeaters_by_sales_channel", "repeaters"), ("repeaters_by_acquisition_channel", "repeaters"),
        ("repeater_discount_usage", "repeaters_count"), ("invoice_counts_repeat", "invoice_count"),
    ):
        counts = [r[column] for r in run(name)]
        assert counts == sorted(counts, reverse=True)
    months = [r.year_month for r in run("revenue_monthly")]
    assert months == sorted(months)
    cohorts_seen = [(r.signup_year_month, r.months_since_signup) for r in run("retention_calendar")]
    assert cohorts_seen == sorted(cohorts_seen)


def test_reports_from_cells_equal_those_from_events(tables, spark, rows):
    events, people = tables.events, tables.customers
    cells = revenue.revenue_cells(events)
    for report in (revenue.revenue_monthly, revenue.revenue_vs_year_ago, revenue.revenue_by_country):
        assert rows(report(cells)) == rows(report(events)) != []
    assert rows(repeaters.repeater_revenue_share(cells, people)) == rows(repeaters.repeater_revenue_share(events, people))
    nothing = revenue.revenue_cells(events.limit(0))
    assert rows(revenue.revenue_monthly(nothing)) == rows(repeaters.repeater_revenue_share(nothing, people)) == []


def test_cells_of_odd_events(make_events, make_customers, rows):
    events = clean.with_final_revenue(
        make_events(
            dict(), dict(event_date=None), dict(country=None), dict(customer_id=None, is_refunded=True),
            dict(event_type="order"), dict(event_type=None, customer_id="C2"), dict(customer_id="C2"), dict(net_revenue_usd=None),
        )
    )
    people, cells = make_customers(dict(), dict()), revenue.revenue_cells(events)
    assert rows(revenue.revenue_monthly(cells)) == rows(revenue.revenue_monthly(events))
    assert rows(revenue.revenue_by_country(cells)) == rows(revenue.revenue_by_country(events))
    assert rows(repeaters.repeater_revenue_share(cells, people)) == rows(repeaters.repeater_revenue_share(events, people))
