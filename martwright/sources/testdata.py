"""The three raw tables derived from the provided order tables (FIXTURES.md section 2).

Used by the registered queries, the tests and the benchmark. Ids are integers here.
Schemas are explicit, which saves a schema inference job per table and query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the mapping in FIXTURES.md.
COUNTRIES = {0: "United States", 1: "Canada", 2: "United Kingdom", 3: "Germany", 4: "Australia"}
SEGMENTS = {"HOUSEHOLD": "Consumer", "FURNITURE": "SOHO", "MACHINERY": "Enterprise"}
ACQUISITION_CHANNELS = {0: "Organic", 1: "Paid Search", 2: "Social", 3: "Email", 4: "Affiliate"}
SALES_CHANNELS = {0: "Website", 1: "Direct Sales", 2: "Reseller", 3: "Partner"}
NAMED_PRODUCTS = {0: "Azure AI Studio Annual Standard", 1: "Notion AI Annual", 2: "Figma Professional Monthly"}
DAYS_FORWARD = 8766
UNKNOWN = 1_000_000_000  # added to an id, gives one that no table has
FIRST_SALES_EARLIER = 2600  # days, before any other event

# The columns read from the provided tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_returnflag string",
}


def _pick(key: Column, values: dict, default: Column | str) -> Column:
    picked = None
    for k, v in values.items():
        picked = F.when(key == k, v) if picked is None else picked.when(key == k, v)
    return picked.otherwise(default)


def _with_unknown(key: str, unknown: Column) -> Column:
    return F.when(unknown, F.col(key) + UNKNOWN).otherwise(F.col(key))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def customers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer")
    nation = _table(spark, sf_dir, "nation")
    region = _table(spark, sf_dir, "region")
    key, home = F.col("c_custkey"), F.col("n_nationkey")
    north_america = home.isin(0, 1)
    return (
        customer.join(nation, F.col("c_nationkey") == home)
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("customer_id"),
            F.date_add(F.lit("2019-01-01").cast("date"), ((key * 37) % 2000).cast("int")).alias("signup_date"),
            F.when(north_america & (key % 2 == 0), "")
            .when(north_america, F.lit(None))
            .otherwise(F.col("r_name"))
            .alias("region_customers"),
            _pick(home, COUNTRIES, F.col("n_name")).alias("country_customers"),
            _pick(F.col("c_mktsegment"), SEGMENTS, "SMB").alias("segment"),
            _pick(key % 6, ACQUISITION_CHANNELS, "Retail Media").alias("acquisition_channel"),
            _pick(home % 3, {0: "USD", 1: "EUR"}, "GBP").alias("currency_preference"),
            _pick(key % 3, {0: "18-34", 1: "35-54"}, "55+").alias("age_band"),
            (home * 3 - 30).cast("double").alias("country_latitude_customers"),
            (home * 7 - 80).cast("double").alias("country_longitude_customers"),
        )
    )


def products_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    plain_or_addon = (
        F.when(key % 7 == 3, F.concat(name, F.lit(" Add?on")))
        .when(key % 11 == 4, F.concat(name, F.lit(" Add–on")))
        .otherwise(name)
    )
    return _table(spark, sf_dir, "part").select(
        key.alias("product_id"),
        _pick(key % 50, NAMED_PRODUCTS, plain_or_addon).alias("product_name"),
        F.col("p_type").alias("category"),
        _pick(size % 3, {0: "Annual", 1: "Monthly"}, "One-time").alias("billing_cycle"),
        (size % 3 != 2).alias("is_subscription"),
        F.col("p_retailprice").alias("base_price_usd"),
        F.col("p_brand").alias("vendor"),
        F.date_add(F.lit("2015-01-01").cast("date"), size * 30).alias("first_release_date"),
        F.when(key % 2 == 0, "Direct").otherwise("Resale").alias("resale_model"),
        F.concat("p_brand", F.lit(" "), "p_type").alias("brand_safe_name"),
        name.alias("product_name_orig"),
        F.col("p_retailprice").alias("base_price_usd_orig"),
        F.concat(F.lit("K-"), "p_brand").alias("base_key"),
        F.concat(F.lit("v"), (size % 5).cast("string")).alias("product_version"),
    )


def _kinds(*numbers: int) -> Column:
    return F.array(*[F.lit(n) for n in numbers])


def events_raw(
    spark: SparkSession, sf_dir: str, geography: bool = True, whole_lines: bool = False
) -> DataFrame:
    """One event per line item, plus an invoice twin for some orders and a first and a
    refunded second sale, 1 to 4 days later, for some customers.

    Some orders and lines name a customer or product that no table has, and some lines
    of one order share their event id.

    `region` and `country` come from the customer. A left join cannot be pruned when
    its columns go unused, so queries that do not read them pass `geography=False`.
    The additional events are exploded from their order line: a union would read and
    join the order tables again.

    `whole_lines` joins the amounts of a line as one array, of which unused ones cannot be
    pruned. All readers of events in a query then shuffle the same columns of the lines, and
    Spark reuses one shuffle for them.
    """
    lines = _table(spark, sf_dir, "lineitem")
    amounts = {c: F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount")}
    if whole_lines:
        lines = lines.withColumn("l_quantity", F.array(*amounts)).withColumnRenamed("l_quantity", "amounts")
        amounts = {c: F.col("amounts")[i] for i, c in enumerate(amounts)}
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        _with_unknown("o_custkey", F.col("o_orderkey") % 97 == 5).alias("customer_id"),
        F.date_add(F.col("o_orderdate").cast("date"), DAYS_FORWARD).alias("order_date"),
        ((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("invoiced"),
    )
    place = []
    if geography:
        home = customers_raw(spark, sf_dir).select(
            "customer_id", F.col("region_customers").alias("region"), F.col("country_customers").alias("country")
        )
        orders = orders.join(home, "customer_id", "left")
        place = ["region", "country"]
    quantity, price, discount = amounts.values()
    key, number, kind = F.col("l_orderkey"), F.col("l_linenumber"), F.col("kind")
    twin, sale, refund = kind == 1, kind == 2, kind == 3
    line_id = F.when((key % 50 == 7) & (number <= 2), F.concat(key.cast("string"), F.lit("-0"))).otherwise(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    )
    has_twin = ~F.col("invoiced") & (F.col("l_partkey") % 200 == 7)
    has_sales = (number == 1) & (key % 60 == 11)
    # Constant arrays stay in generated code; a function over an array for each row would not.
    kinds = (
        F.when(has_twin & has_sales, _kinds(0, 1, 2, 3))
        .when(has_twin, _kinds(0, 1))
        .when(has_sales, _kinds(0, 2, 3))
        .otherwise(_kinds(0))
    )
    first_sale = F.date_sub("order_date", FIRST_SALES_EARLIER)
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("kind", F.explode(kinds))
        .select(
            F.concat(line_id, _pick(kind, {1: "-inv", 2: "-first", 3: "-second"}, "")).alias("event_id"),
            "customer_id",
            _with_unknown("l_partkey", key % 89 == 3).alias("product_id"),
            F.when(twin, F.date_add("order_date", number * 5 - 10))
            .when(sale, first_sale)
            .when(refund, F.date_add(first_sale, (F.col("customer_id") % 4 + 1).cast("int")))
            .otherwise(F.col("order_date"))
            .alias("event_date"),
            F.when((kind > 0) | F.col("invoiced"), "invoice").otherwise("order").alias("event_type"),
            quantity.cast("int").alias("quantity"),
            price.alias("unit_price_local"),
            # A third of the lines have four decimals.
            (
                F.floor(price * (1 - discount) * 100).cast("double") / 100
                + F.when(F.col("l_linenumber") % 3 == 0, F.lit(0.0037)).otherwise(F.lit(0.0))
            ).alias("net_revenue_usd"),
            F.when(kind > 1, refund).otherwise(F.col("l_returnflag") == "R").alias("is_refunded"),
            F.when(discount < 0.03, "N/A")
            .when(discount < 0.06, "WELCOME10")
            .when(discount < 0.09, "SAVE5")
            .otherwise("LOYALTY15")
            .alias("discount_code"),
            _pick(F.col("l_suppkey") % 5, SALES_CHANNELS, "Marketplace").alias("channel"),
            *place,
        )
    )
