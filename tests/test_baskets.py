import itertools
import random

import pytest

from martwright.operators import baskets


def test_baskets_keep_refunds_and_null_customers(make_events, make_products, rows):
    events = make_events(
        dict(is_refunded=True), dict(event_type="order"), dict(customer_id=None), dict(product_id="P9"),
    )
    assert rows(baskets.events_baskets(events, make_products(dict())), "basket_id", "product_id", "product_name") == [
        ("C1_2024-01-01", "P1", "Plan"), ("C1_2024-01-01", "P9", None), ("_2024-01-01", "P1", "Plan"),
    ]


def test_min2_needs_two_different_products(make_events, rows):
    events = make_events(
        dict(), dict(), dict(product_id="P2"),
        dict(customer_id="C2"), dict(customer_id="C2"),
        dict(customer_id=None), dict(customer_id="", product_id="P2"),
        dict(customer_id="C3"), dict(customer_id="C3", product_id=None),
    )
    got = rows(baskets.events_baskets_min2(baskets.basket_rows(events)), "basket_id", "product_id")
    first, shared = "C1_2024-01-01", "_2024-01-01"
    assert got == [(first, "P1"), (first, "P1"), (first, "P2"), (shared, "P1"), (shared, "P2")]


@pytest.mark.parametrize("block_size", [1000, 3, 1])
def test_pairs_in_blocks_equal_brute_force(make_events, make_products, rows, block_size):
    random.seed(7)
    sales = [(random.choice("AAAAAAABC"), f"P{random.randint(1, 25):02}") for _ in range(120)]
    events = make_events(*(dict(customer_id=c, product_id=p) for c, p in sales), dict(customer_id="Z"))
    products = make_products(*(dict(product_id=f"P{n:02}", product_name=f"name {n}") for n in range(1, 20)))
    expected = {}
    for c in "ABC":
        for pair in itertools.combinations(sorted({p for x, p in sales if x == c}), 2):
            expected[pair] = expected.get(pair, 0) + 1

    def name(p):
        return f"name {int(p[1:])}" if int(p[1:]) < 20 else None

    got = rows(baskets.product_pairs(baskets.basket_rows(events), products, block_size))
    assert got == sorted(((a, name(a), b, name(b), n) for (a, b), n in expected.items()), key=repr)


def test_preview_is_ordered(make_events, rows):
    events = make_events(*(dict(product_id=f"P{n}") for n in range(9)), dict(product_id=None))
    assert rows(baskets.preview(events, ["product_id"], 3), "product_id") == [("P0",), ("P1",), ("P2",)]
