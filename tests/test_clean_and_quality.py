from conftest import day
from martwright.operators import clean, quality


def test_regions_filled_only_where_blank_and_north_american(make_events, rows):
    events = make_events(
        dict(region=None, country="Canada"), dict(region="", country="United States"),
        dict(region="LATAM", country="Canada"), dict(region=None, country="Germany"),
        dict(region="", country="Germany"), dict(region=None, country=None),
    )
    got = dict(rows(clean.fill_blank_region(events), "event_id", "region"))
    assert got == {"E1": "NAm", "E2": "NAm", "E3": "LATAM", "E4": None, "E5": "", "E6": None}


def test_events_clean_columns(make_events, rows):
    events = make_events(
        dict(discount_code="N/A"), dict(discount_code="SAVE5", event_type="order"),
        dict(discount_code=None, is_refunded=True), dict(is_refunded=None, event_date="2024-02-29"),
    )
    got = rows(clean.events_clean(events), "event_id", "discount_group", "final_net_revenue_usd", "year_month")
    assert got == [
        ("E1", "Full Price", 10.0, day("2024-01-01")), ("E2", "SAVE5", 0.0, day("2024-01-01")),
        ("E3", None, 0.0, day("2024-01-01")), ("E4", "Full Price", 0.0, day("2024-02-01")),
    ]


def test_customers_clean(make_customers, rows):
    customers = make_customers(dict(region_customers="", country_customers="Canada", signup_date="2024-03-31"))
    assert rows(clean.customers_clean(customers), "region_customers", "signup_year_month") == [("NAm", day("2024-03-01"))]


def test_rename_geography(spark):
    df = spark.createDataFrame([("EU", "Germany", 1)], "region string, country string, n int")
    assert clean.rename_geography(df).columns == ["region_customers", "country_customers", "n"]


def test_product_names(make_products, rows):
    products = make_products(dict(product_name="A Add?on"), dict(product_name="B"), dict(product_name="C Add–on Add–on"))
    final = clean.products_final(products)
    assert tuple(final.columns) == clean.PRODUCT_COLUMNS
    assert rows(final, "product_id", "product_name") == [("P1", "A Add-on"), ("P2", "B"), ("P3", "C Add-on Add–on")]
    assert rows(quality.foreign_font_values(products), "product_id", "non_ascii", "addon_variant") == [
        ("P1", False, True), ("P3", True, True),
    ]
    fine = make_products(dict(product_name="A Add-on"), dict(product_name="Café"), dict(product_name=None))
    assert rows(quality.foreign_font_values(fine), "product_id", "non_ascii", "addon_variant") == [("P2", True, False)]


def test_duplicate_ids(make_events, rows):
    events = make_events(dict(event_id="A"), dict(event_id="A"), dict(event_id="B"), dict(event_id="C"))
    assert rows(quality.duplicate_event_ids(events)) == [("A", 2)]
    assert rows(quality.event_id_summary(events)) == [(4, 3, 1)]
    assert rows(quality.event_id_summary(events.limit(0))) == [(0, 0, 0)]


def test_refund_checks(make_events, rows):
    events = clean.with_final_revenue(make_events(dict(is_refunded=True), dict(event_type="order", is_refunded=True), dict()))
    assert rows(quality.refund_audit(events)) == [(10.0, True, "invoice", 0.0), (10.0, True, "order", 0.0)]
    assert len(rows(quality.refund_audit(events, rows=1))) == 1
    assert rows(quality.refund_violations(events)) == [("invoice", 1, 0), ("order", 1, 0)]
    broken = events.withColumn("final_net_revenue_usd", events["net_revenue_usd"])
    assert rows(quality.refund_violations(broken)) == [("invoice", 1, 1), ("order", 1, 1)]


def test_orphan_keys(make_events, make_customers, make_products, rows):
    events = make_events(
        dict(customer_id="C1"), dict(customer_id="C9"), dict(customer_id="C9"), dict(customer_id=None),
        dict(product_id="P9"),
    )
    got = quality.orphan_keys(events, make_customers(dict()), make_products(dict()))
    assert rows(got) == [("customers_raw", "customer_id", 1, 2), ("products_raw", "product_id", 1, 1)]
    clean_tables = quality.orphan_keys(events.limit(0), make_customers(dict()), make_products(dict()))
    assert rows(clean_tables) == [("customers_raw", "customer_id", 0, 0), ("products_raw", "product_id", 0, 0)]


def test_blank_profile(make_events, rows):
    got = quality.blank_profile(make_events(dict(region=None), dict(region=""), dict(quantity=None)), "events_raw")
    blanks = {r[1]: r[3] for r in rows(got)}
    assert blanks["region"] == 2 and blanks["quantity"] == 1 and blanks["country"] == 0
    assert {r[2] for r in rows(got)} == {3}


def test_invoices_before_signup(make_events, make_customers, rows):
    customers = make_customers(dict(signup_date="2024-02-10"), dict(signup_date="2024-02-20"), dict(signup_date=None))
    events = make_events(
        dict(customer_id="C1", event_date="2024-02-09"), dict(customer_id="C1", event_date="2024-02-09"),
        dict(customer_id="C1", event_date="2024-02-10"), dict(customer_id="C2", event_date="2023-01-01"),
        dict(customer_id="C2", event_date="2023-01-01", event_type="order"), dict(customer_id="C3"), dict(customer_id="C9"),
    )
    assert rows(quality.invoices_before_signup(events, customers)) == [(day("2024-02-01"), 3, 2)]
