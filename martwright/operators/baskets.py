"""Market baskets: what one customer was invoiced for on one day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.functions.columns import concat_skipping_nulls, month_start
from martwright.functions.joins import splittable_join
from martwright.operators.clean import ADDON


def basket_rows(events: DataFrame) -> DataFrame:
    """Invoiced events, refunded ones too, with their basket id (customer and day)."""
    return events.where(F.col("event_type") == "invoice").select(
        concat_skipping_nulls("customer_id", F.lit("_"), "event_date").alias("basket_id"),
        "customer_id",
        "event_date",
        "product_id",
    )


def events_baskets(events: DataFrame, products: DataFrame) -> DataFrame:
    """Basket rows with product names."""
    return basket_rows(events).join(products.select("product_id", "product_name"), "product_id", "left").select(
        "basket_id", "customer_id", "event_date", "product_id", "product_name"
    )


def events_baskets_min2(baskets: DataFrame) -> DataFrame:
    """Rows of baskets with at least two different products.

    Two different products means least < greatest: one grouping, where a distinct count
    would shuffle every (basket, product). The grouping is by customer and day and the
    basket id is built after it, so the semi join shuffles both inputs by basket and
    AQE can split an oversized basket.
    """
    customer = F.coalesce(F.col("customer_id").cast("string"), F.lit(""))
    several = (
        baskets.groupBy(customer.alias("customer_id"), "event_date")
        .agg(F.min("product_id").alias("least"), F.max("product_id").alias("greatest"))
        .where("least < greatest")
        .select(concat_skipping_nulls("customer_id", F.lit("_"), "event_date").alias("basket_id"))
    )
    return baskets.join(several, "basket_id", "left_semi")


def product_pairs(baskets: DataFrame, products: DataFrame, block_size: int = 1000) -> DataFrame:
    """Unordered product pairs with the number of baskets holding both.

    Products are made distinct per basket first, so repeats cost nothing and a plain
    count is a distinct basket count; baskets of one product drop out before the self
    join. A basket of n products has n(n-1)/2 pairs, all part of the result. One with
    more than `block_size` products is cut into blocks: each row belongs to one block on
    the left and is copied to every block on the right, so each pair meets exactly once
    and a large basket is spread over many tasks. Names are joined to the counted pairs.
    """
    items = baskets.where(F.col("product_id").isNotNull()).select("basket_id", "product_id").distinct()
    sizes = items.groupBy("basket_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A basket's products never meet in one task: its size is joined back to them.
    sized = splittable_join(items, sizes, "basket_id").withColumn("blocks", F.ceil(F.col("n") / block_size).cast("int"))
    left = sized.select(
        "basket_id", F.col("product_id").alias("product_a_id"), F.expr("pmod(hash(product_id), blocks)").alias("block")
    )
    right = sized.select(
        "basket_id",
        F.col("product_id").alias("product_b_id"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    pairs = (
        left.join(right, ["basket_id", "block"])
        .where(F.col("product_a_id") < F.col("product_b_id"))
        .groupBy("product_a_id", "product_b_id")
        .agg(F.count(F.lit(1)).alias("pair_count"))
    )

    def names(side: str) -> DataFrame:
        return products.select(
            F.col("product_id").alias(f"product_{side}_id"), F.col("product_name").alias(f"product_{side}_name")
        )

    return (
        pairs.join(names("a"), "product_a_id", "left")
        .join(names("b"), "product_b_id", "left")
        .select("product_a_id", "product_a_name", "product_b_id", "product_b_name", "pair_count")
    )


def preview(df: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    """The first rows in a given order: a top-k, not a full sort."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(rows)


def attachment_rate(events: DataFrame, products: DataFrame) -> DataFrame:
    """Per month: customers invoiced for an add-on over customers invoiced for a plan.

    An add-on has 'Add-on' in its repaired name; every other named product is a plan.
    """
    kinds = products.select("product_id", F.col("product_name").contains(ADDON).alias("is_addon"))
    per_customer = (
        events.where(F.col("event_type") == "invoice")
        .select("product_id", "customer_id", "event_date")
        .join(kinds, "product_id", "left")
        .groupBy(month_start("event_date").alias("year_month"), "customer_id")
        .agg(F.max("is_addon").alias("any_addon"), F.max(~F.col("is_addon")).alias("any_plan"))
    )
    return (
        per_customer.groupBy("year_month")
        .agg(
            F.count(F.when(F.col("any_addon"), F.col("customer_id"))).alias("addon_customers"),
            F.count(F.when(F.col("any_plan"), F.col("customer_id"))).alias("plan_customers"),
        )
        .withColumn("attachment_rate", F.try_divide("addon_customers", "plan_customers"))
        .orderBy(F.col("year_month").asc_nulls_last())
    )
