"""Comparison with the year before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_year_ago(df: DataFrame, keys: list[str], value: str, year: str = "year") -> DataFrame:
    """Add `<value>_year_ago`: the value of the same keys one calendar year earlier.

    `df` holds one row per (keys, year). Each row is sent to its own year and, as the
    year-ago figure, to the next one; one grouping then lines both up. That needs
    neither a self join nor a window over all years of a key.
    """
    ago = f"{value}_year_ago"
    empty = F.lit(None).cast(df.schema[value].dataType)
    return (
        df.select(
            *keys,
            F.explode(
                F.array(
                    F.struct(F.col(year).alias(year), F.col(value).alias(value), empty.alias(ago),
                             F.lit(True).alias("present")),
                    F.struct((F.col(year) + 1).alias(year), empty.alias(value), F.col(value).alias(ago),
                             F.lit(False).alias("present")),
                )
            ).alias("r"),
        )
        .select(*keys, "r.*")
        .groupBy(*keys, year)
        .agg(F.max(value).alias(value), F.max(ago).alias(ago), F.max("present").alias("present"))
        .where("present")
        .drop("present")
    )
