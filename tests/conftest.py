import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from martwright.session import builder  # noqa: E402
from martwright.sources import tables  # noqa: E402

SF = os.environ.get("TEST_SF", "0.001")
SF_DIR = os.environ.get("TEST_SF_DIR", f"/root/testdata/sf{SF}")


@pytest.fixture(scope="session")
def spark():
    session = (
        builder("tests")
        .master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def day(text):
    return dt.date.fromisoformat(text)


EVENT_DEFAULTS = dict(
    customer_id="C1", product_id="P1", event_date=day("2024-01-01"), event_type="invoice", quantity=1,
    unit_price_local=10.0, net_revenue_usd=10.0, is_refunded=False, discount_code="N/A", channel="Website",
    region="EU", country="Germany",
)
CUSTOMER_DEFAULTS = dict(signup_date=day("2023-12-15"), segment="SMB", acquisition_channel="Email")
PRODUCT_DEFAULTS = dict(product_name="Plan", category="Tools", billing_cycle="Annual", base_price_usd=10.0)


def _frame(spark, schema, rows, defaults, key):
    prepared = []
    for n, row in enumerate(rows, 1):
        filled = {**defaults, key: f"{key[0].upper()}{n}", **row}
        for field in schema.names:
            value = filled.get(field)
            if isinstance(value, str) and schema[field].dataType.typeName() == "date":
                value = day(value)
            filled[field] = value
        prepared.append(tuple(filled[f] for f in schema.names))
    return spark.createDataFrame(prepared, schema)


@pytest.fixture
def make_events(spark):
    """Raw events from dicts; columns left out take a default."""
    return lambda *rows: _frame(spark, tables.EVENTS, rows, EVENT_DEFAULTS, "event_id")


@pytest.fixture
def make_customers(spark):
    return lambda *rows: _frame(spark, tables.CUSTOMERS, rows, CUSTOMER_DEFAULTS, "customer_id")


@pytest.fixture
def make_products(spark):
    return lambda *rows: _frame(spark, tables.PRODUCTS, rows, PRODUCT_DEFAULTS, "product_id")


@pytest.fixture
def rows():
    """Collected rows as a sorted list of plain tuples, optionally of some columns."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return collect
