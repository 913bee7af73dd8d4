"""The three raw tables and their readers.

Schemas are explicit: no inference pass over the data, and a wrong file fails early
instead of reading as NULLs or as shifted columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.operators.clean import rename_geography


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


EVENTS = _schema(
    event_id=T.StringType(),
    customer_id=T.StringType(),
    product_id=T.StringType(),
    event_date=T.DateType(),
    event_type=T.StringType(),
    quantity=T.IntegerType(),
    unit_price_local=T.DoubleType(),
    net_revenue_usd=T.DoubleType(),
    is_refunded=T.BooleanType(),
    discount_code=T.StringType(),
    channel=T.StringType(),
    region=T.StringType(),
    country=T.StringType(),
)

CUSTOMERS = _schema(
    customer_id=T.StringType(),
    signup_date=T.DateType(),
    region_customers=T.StringType(),
    currency_preference=T.StringType(),
    segment=T.StringType(),
    acquisition_channel=T.StringType(),
    age_band=T.StringType(),
    country_customers=T.StringType(),
    country_latitude_customers=T.DoubleType(),
    country_longitude_customers=T.DoubleType(),
)

PRODUCTS = _schema(
    product_id=T.StringType(),
    product_name=T.StringType(),
    category=T.StringType(),
    is_subscription=T.BooleanType(),
    billing_cycle=T.StringType(),
    base_price_usd=T.DoubleType(),
    first_release_date=T.DateType(),
    vendor=T.StringType(),
    resale_model=T.StringType(),
    brand_safe_name=T.StringType(),
    product_name_orig=T.StringType(),
    base_price_usd_orig=T.DoubleType(),
    base_key=T.StringType(),
    product_version=T.StringType(),
)


def _options(format: str, options: dict) -> dict:
    return {"header": True, "enforceSchema": False, "mode": "FAILFAST", **options} if format == "csv" else options


def _read(spark: SparkSession, path: str, schema: T.StructType, format: str, **options) -> DataFrame:
    options = _options(format, options)
    if format != "csv":
        # Self-describing files fill missing columns with NULL; their footers tell.
        missing = set(schema.names) - set(spark.read.options(**options).format(format).load(path).columns)
        if missing:
            raise ValueError(f"{path} lacks columns {sorted(missing)}")
    return spark.read.schema(schema).options(**options).format(format).load(path)


def read_events(spark: SparkSession, path: str, format: str = "parquet", schema=EVENTS, **options) -> DataFrame:
    """events_raw: one row per order or invoice line."""
    return _read(spark, path, schema, format, **options)


def _imported(found: T.StructType, schema: T.StructType, as_found: set[str]) -> T.StructType:
    """`schema` with region and country named as in the file, columns `as_found` of its types."""
    plain = {f"{c}_customers": c for c in ("region", "country") if c in found.names}
    return T.StructType(
        [
            T.StructField(
                plain.get(f.name, f.name) if f.name not in found.names else f.name,
                found[f.name].dataType if f.name in as_found and f.name in found.names else f.dataType,
            )
            for f in schema
        ]
    )


def _in_order_of(found: T.StructType, given: T.StructType) -> T.StructType:
    return T.StructType(sorted(given, key=lambda f: found.names.index(f.name) if f.name in found.names else -1))


def read_customers(spark: SparkSession, path: str, format: str = "parquet", schema=CUSTOMERS, **options) -> DataFrame:
    """customers_raw: one row per customer.

    The table may be as imported: `region` and `country` without their suffix, and
    `signup_date` as a date, a timestamp or a text that begins with an ISO date.
    """
    found = spark.read.options(**_options(format, options)).format(format).load(path).schema
    given = _imported(found, schema, {"signup_date"})
    if format == "csv":  # columns are read in the file's order
        given = _in_order_of(found, given)
    read = rename_geography(_read(spark, path, given, format, **options))
    return read.select(*[read[f.name].cast(f.dataType) if f.name == "signup_date" else read[f.name] for f in schema])


def read_products(spark: SparkSession, path: str, format: str = "parquet", schema=PRODUCTS, **options) -> DataFrame:
    """products_raw: one row per product."""
    return _read(spark, path, schema, format, **options)


def read_with_rejects(
    spark: SparkSession, path: str, schema: T.StructType = EVENTS, **options
) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV table that fit the schema, and the lines that don't.

    The second table has path, reason and line: reason is `columns` for a line with more
    or fewer values than columns, otherwise the first column whose text is no value of its
    type; the line is as in the file, or for the latter its values written as CSV again.
    Every line is in one of the two, each once. A header with other columns than the schema's is an
    error still: that is another table, not a bad line. Both are lazy and read the file;
    `rejects_by_reason` counts.
    """
    bad = "__line"
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField(bad, T.StringType())])
    chosen = {**_options("csv", options), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    lines = spark.read.schema(texts).options(**chosen).csv(path)
    values = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema}
    # Every column is named, so that pruning never leaves the parser fewer to check a line by.
    whole = F.to_csv(F.struct(*[F.col(f.name) for f in schema]))
    wrong = F.when(F.col(bad).isNotNull(), "columns")
    for f in schema:
        wrong = wrong.when(F.col(f.name).isNotNull() & values[f.name].isNull(), f.name)
    checked = lines.select(
        F.col("_metadata.file_path").alias("__path"), "*", whole.alias("__whole"), wrong.alias("__reason")
    )
    good = checked.where("__reason is null").select(*[values[f.name].alias(f.name) for f in schema])
    rejects = checked.where("__reason is not null").select(
        F.col("__path").alias("path"), F.col("__reason").alias("reason"), F.coalesce(bad, "__whole").alias("line")
    )
    return good, rejects


def read_customers_with_rejects(
    spark: SparkSession, path: str, schema: T.StructType = CUSTOMERS, **options
) -> tuple[DataFrame, DataFrame]:
    """`read_with_rejects` for a customer table as imported (see `read_customers`)."""
    found = spark.read.options(**_options("csv", options)).csv(path).schema
    good, rejects = read_with_rejects(spark, path, _in_order_of(found, _imported(found, schema, set())), **options)
    return rename_geography(good).select(*schema.names), rejects


def rejects_by_reason(rejects: DataFrame) -> DataFrame:
    """Rejected lines per file and reason, most first."""
    counted = rejects.groupBy("path", "reason").agg(F.count(F.lit(1)).alias("lines"))
    return counted.orderBy(F.col("lines").desc(), "path", "reason")
