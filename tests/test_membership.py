"""Bit maps of keys: never a wrong false, and what they keep out of the shuffle."""

import random

import pytest
from pyspark.sql import functions as F
from test_plans import LARGE, SMALL_SKEW, final_plan, hot_events, settings, skewed_joins  # noqa: F401

from martwright.functions.membership import BITS, key_map, with_possible_partner
from martwright.operators import reconcile, repeaters
from martwright.sources import testdata


@pytest.mark.parametrize("bits", [1, 1 << 15, 1 << 27])
def test_a_partner_is_never_denied(spark, bits):
    rng = random.Random(1)
    values = [0.0, -0.0, float("nan"), float("inf"), None, *[float(rng.randrange(10**6)) for _ in range(3000)]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    table = rows.where("id % 3 = 0 or id < 3").select(F.col("v").alias("w"))
    got = with_possible_partner(rows, ["v"], key_map(table, ["w"], bits), "maybe", bits)
    assert got.columns == ["id", "v", "maybe"]
    found = {r.id: r.maybe for r in got.collect()}
    assert len(found) == len(values) and all(found[i] for i in range(len(values)) if i % 3 == 0 or i < 3)
    false = sum(not m for m in found.values())
    assert false == 0 if bits < 8 else false > (1500 if bits == 1 << 15 else 1990)


def test_no_key_at_all(spark):
    rows = spark.createDataFrame([(1,), (None,)], "v int")
    got = with_possible_partner(rows, ["v"], key_map(rows.limit(0), ["v"]), "maybe")
    assert [r.maybe for r in got.collect()] == [False, False]


@pytest.mark.parametrize("name", ["orders_not_proceed", "invoices_not_orders"])
@pytest.mark.parametrize("bits", [1000, 1 << 27])
def test_equal_rows_with_and_without_map(spark, sf_dir, rows, name, bits):
    events = testdata.events_raw(spark, sf_dir, geography=False)
    nulls = events.limit(50).withColumn("product_id", F.lit(None).cast("bigint"))
    events = events.unionByName(nulls).withColumn(
        "net_revenue_usd", F.when(F.col("quantity") == 7, F.lit(-0.0)).when(F.col("quantity") == 8, 0.0).otherwise(F.col("net_revenue_usd"))
    )
    operator = getattr(reconcile, name)
    assert rows(operator(events, bits=bits)) == rows(operator(events, bits=0))


def test_partnerless_rows_skip_the_shuffle(spark, settings, hot_events):  # noqa: F811
    """All but one row of the left side have no partner: the anti join gets that one."""
    settings(LARGE)
    events = hot_events.withColumn("unit_price_local", F.rand(2))
    one = events.where("event_type = 'order'").limit(1)
    events = events.unionByName(one.withColumn("event_type", F.lit("invoice"))).cache()
    orders = events.where("event_type = 'order'").count()
    left = reconcile.orders_not_proceed(events, bits=BITS)
    assert left.count() == orders - events.where("event_type = 'invoice'").join(
        events.where("event_type = 'order'").select(*reconcile.MATCH_KEYS), list(reconcile.MATCH_KEYS), "left_semi"
    ).count()
    execution = left._jdf.queryExecution()
    execution.toRdd().count()
    assert "BroadcastHashJoin" in execution.executedPlan().toString()
    keys = key_map(events.where("event_type = 'invoice'"), reconcile.MATCH_KEYS)
    doubtful = with_possible_partner(events.where("event_type = 'order'"), reconcile.MATCH_KEYS, keys, "maybe").where("maybe")
    assert doubtful.count() <= 1 + orders // 100
    events.unpersist()


def test_hot_customer_with_many_codes_is_split(spark, settings, make_customers):  # noqa: F811
    """One customer has 100,000 discount codes; no window or task sees them all."""
    settings({**SMALL_SKEW, "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB"})  # several tasks write the counts
    n = F.col("id")
    events = spark.range(150_000, numPartitions=8).select(
        F.when(n < 100_000, "HOT").otherwise(F.concat(F.lit("C"), n % 3000)).alias("customer_id"),
        F.concat(F.lit("code "), F.when(n < 100_000, n).otherwise(n % 5)).alias("discount_group"),
        F.when(n % 2 == 0, "invoice").otherwise("order").alias("event_type"),
    )
    people = make_customers(*({"customer_id": c} for c in ["HOT", *(f"C{k}" for k in range(2000))]))
    used = repeaters.repeater_discount_usage(events, people)
    text = final_plan(used)
    assert "Window" not in text and skewed_joins(text) >= 1 and "ReusedExchange" in text
    twice = events.where("event_type = 'invoice'").groupBy("customer_id").count().where("count > 1")
    kept = events.join(twice, "customer_id", "left_semi").join(people, "customer_id", "left_semi")
    assert used.agg(F.sum("repeaters_count")).first()[0] == kept.count()
    assert used.count() == kept.select("discount_group").distinct().count()
