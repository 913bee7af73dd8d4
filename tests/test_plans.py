"""Plan shapes that decide whether a query scales, and behaviour under a hot key."""

import re

import pytest
from pyspark.sql import functions as F

from martwright.operators import baskets, customers, events, mart, reconcile, repeaters
from martwright.operators.clean import with_final_revenue
from martwright.plans.queries import queries

# Everything stays a shuffle join, as with tables far beyond the broadcast threshold.
LARGE = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
# The same skew rule as on a cluster, with sizes to fit the test.
SMALL_SKEW = {
    **LARGE,
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
}


@pytest.fixture
def settings(spark):
    changed = {}

    def apply(values):
        for key, value in values.items():
            changed.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield apply
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan after AQE: run it, then read the same execution's plan."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString()


@pytest.mark.parametrize("name", queries())
def test_no_cross_join_no_python_no_unbounded_windows(name, spark, sf_dir, settings):
    settings(LARGE)
    text = plan(queries()[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in text
    # One task may only ever merge partial aggregates, of which there is one row per task.
    lines = text.splitlines()
    for above, below in zip(lines, lines[1:]):
        assert "SinglePartition" not in above or "Aggregate" in below
    # Only partition-wide frames may be unbounded on the right; a growing frame there is quadratic.
    assert not re.search(r"specifiedwindowframe\(RowFrame, currentrow\$\(\), unboundedfollowing", text)


def test_second_purchase_is_limited_before_the_shuffle(spark, sf_dir):
    text = plan(queries()["customers_final"](spark, sf_dir))
    limit, exchange = text.rindex("WindowGroupLimit"), text.rindex("Exchange hashpartitioning(customer_id")
    assert "row_number(), 2, Partial" in text and limit > exchange


def test_filters_and_columns_reach_the_scan(spark, make_events, tmp_path):
    path = str(tmp_path / "events")
    make_events(dict(), dict(event_type="order")).write.parquet(path)
    scanned = spark.read.parquet(path)
    text = plan(customers.second_purchase_gap(scanned))
    assert "EqualTo(event_type,invoice)" in text and "IsNotNull(customer_id)" in text
    assert "country" not in text.split("ReadSchema")[1].split("\n")[0]
    counts = plan(reconcile.order_invoice_counts(scanned))
    assert "Join" not in counts


def test_mart_customer_join_adds_no_shuffle(spark, sf_dir, settings):
    """customer_days and customers_final are partitioned alike, so they join in place."""
    settings(LARGE)
    text = plan(queries()["combined"](spark, sf_dir))
    join = re.search(r"SortMergeJoin \[day_customer_id#\d+L?\], \[customer_id_c#\d+L?\].*\n(.*\n){3}", text).group(0)
    assert "Exchange" not in join


def _shuffled(df, key):
    """Columns of the widest shuffle by `key`."""
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if node.nodeName() == "Exchange" and f"hashpartitioning({key}#" in node.outputPartitioning().toString():
            found.append([node.output().apply(i).name() for i in range(node.output().size())])
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return max(found, key=len)


@pytest.mark.parametrize("name", ["events_final", "combined"])
def test_events_are_shuffled_by_day_without_derived_columns(name, spark, sf_dir, settings):
    settings(LARGE)
    text = plan(queries()[name](spark, sf_dir))
    # Both inputs of the join are hashed by coalesced keys; the events' own columns come below it.
    below = text[re.search(r"SortMergeJoin \[coalesce\(customer_id", text).end() :]
    for derived in ("discount_group#", "year_month#", "final_net_revenue_usd#"):
        assert not re.search(rf"(?<!\w){derived}", below)


def test_mart_is_shuffled_by_product_without_profiles_and_derived_columns(spark, sf_dir, settings):
    settings(LARGE)
    carried = _shuffled(queries()["combined"](spark, sf_dir), "product_id")
    assert "event_id" in carried and "signup_date" in carried
    dropped = {*mart.PROFILE_COLUMNS, "days_to_next_invoice", "customer_id_c", "discount_group", "final_net_revenue_usd"}
    assert not dropped & set(carried)


def test_mart_carries_texts_as_one_column(spark, sf_dir, settings):
    settings(LARGE)
    df = queries()["combined"](spark, sf_dir)
    for key in ("product_id", "coalesce(customer_id"):
        carried = _shuffled(df, key)
        assert "event_id" in carried and not {*mart.EVENT_TEXTS, "signup_year_month"} & set(carried)


def test_mart_is_shuffled_by_product_in_the_order_of_types(spark, sf_dir, settings):
    settings(LARGE)
    df = queries()["combined"](spark, sf_dir)
    types = dict(df.dtypes) | {"__known": "boolean", "__profile": "bigint", "__packed": "string"}
    carried = [types[c] for c in _shuffled(df, "product_id")]
    order = [*mart.NARROW_FIRST, "string"]
    assert carried == sorted(carried, key=order.index) and set(carried) == set(order)


def test_mart_shuffles_order_lines_once(spark, sf_dir, settings):
    """Events, customer-days and second purchases read the lines; two of the three reuse one shuffle."""
    settings(LARGE)
    text = final_plan(queries()["combined"](spark, sf_dir)).split("== Initial Plan ==")[0]
    shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning(l_orderkey#" in line]
    assert ["ReusedExchange" in line for line in shuffles].count(True) == 2 and len(shuffles) == 3


def test_basket_items_are_computed_once(spark, sf_dir, settings):
    settings(LARGE)
    assert "ReusedExchange" in final_plan(queries()["product_pairs"](spark, sf_dir))


HOT = 20_000


@pytest.fixture
def hot_events(spark):
    """A third of all events belong to one customer, and a third of those to one day."""
    n = F.col("id")
    hot = n % 3 == 0
    return with_final_revenue(
        spark.range(0, 3 * HOT, numPartitions=12).select(
            F.concat(F.lit("E"), n).alias("event_id"),
            F.when(hot, "HOT").otherwise(F.concat(F.lit("C"), n % 5000)).alias("customer_id"),
            F.concat(F.lit("P"), n % 40).alias("product_id"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.when(hot & (n % 9 == 0), 0).otherwise((n % 300).cast("int"))).alias("event_date"),
            F.when(n % 2 == 0, "invoice").otherwise("order").alias("event_type"),
            F.lit(1).alias("quantity"),
            F.lit(10.0).alias("unit_price_local"),
            F.lit(10.0).alias("net_revenue_usd"),
            F.lit(False).alias("is_refunded"),
        )
    )


def skewed_joins(text):
    return len(re.findall(r"(?:SortMerge|ShuffledHash)Join\(skew=true\)", text))


def test_hot_day_is_split_in_event_timing(hot_events, settings):
    settings(SMALL_SKEW)
    timed = events.events_final(hot_events)
    assert skewed_joins(final_plan(timed)) >= 1
    assert timed.count() == 3 * HOT


def test_hot_basket_is_split_in_min2(hot_events, settings):
    settings(SMALL_SKEW)
    several = baskets.events_baskets_min2(baskets.basket_rows(hot_events))
    assert skewed_joins(final_plan(several)) >= 1


def test_hot_deal_is_split_in_reconciliation(spark, settings, hot_events):
    settings(SMALL_SKEW)
    deals = hot_events.withColumn("unit_price_local", F.when(F.col("customer_id") == "HOT", 1.0).otherwise(F.rand(1)))
    deals = deals.withColumn("event_type", F.when(F.col("event_date") == "2024-01-01", "order").otherwise(F.col("event_type")))
    deals = deals.withColumn("product_id", F.when(F.col("customer_id") == "HOT", "P0").otherwise(F.col("product_id")))
    left = reconcile.orders_not_proceed(deals)
    assert skewed_joins(final_plan(left)) >= 1


def test_hot_customer_is_split_in_repeater_products(hot_events, make_customers, settings):
    settings(SMALL_SKEW)
    people = make_customers(*({"customer_id": c} for c in ["HOT", *(f"C{n}" for n in range(5000))]))
    counted = repeaters.repeater_products_by_segment(hot_events, people)
    assert skewed_joins(final_plan(counted)) >= 1
    twice = hot_events.where("event_type = 'invoice'").groupBy("customer_id").count().where("count > 1")
    expected = hot_events.join(twice, "customer_id", "left_semi").count()
    assert counted.agg(F.sum("products_smb_repeater")).first()[0] == expected


def test_windows_see_one_row_per_customer_and_day(hot_events):
    per_customer = events.customer_days(hot_events).groupBy("day_customer_id").count()
    assert per_customer.agg(F.max("count")).first()[0] <= 300


def test_one_large_basket_is_spread_over_blocks(spark, make_products, settings):
    """A basket of 600 products, in blocks of 50, gives all its pairs."""
    settings(LARGE)
    rows = spark.range(600).select(F.lit("HOT_2024-01-01").alias("basket_id"), F.col("id").cast("string").alias("product_id"))
    pairs = baskets.product_pairs(rows, make_products(dict()), block_size=50)
    assert pairs.count() == 600 * 599 // 2
