"""Exports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.functions.columns import parts


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write CSV with a header, one file per task."""
    df.write.mode(mode).option("header", True).csv(path)


def export_chunks(
    df: DataFrame,
    path: str,
    date: str = "event_date",
    grain: str = "year",
    format: str = "csv",
    mode: str = "errorifexists",
) -> None:
    """Write one directory per period of `date`: `chunk_year=2024/` and so on.

    Rows are rebalanced by period before the write: a period gets as many files of the
    advisory partition size as it needs, instead of one small file per task and period
    or a single task for a large period. Files are sorted by date, so readers can skip
    directories by period and row groups by date; the writer needs its rows grouped by
    period anyway, and this order provides that.
    """
    _write_chunks(_chunked(df, date, grain), path, date, grain, format, mode)


def _chunked(df: DataFrame, date: str, grain: str) -> DataFrame:
    period = {
        "year": F.year(date),
        "quarter": F.concat(F.year(date), F.lit("-Q"), F.quarter(date)),
        "month": F.date_format(date, "yyyy-MM"),
    }[grain]
    return df.withColumn(f"chunk_{grain}", period)


def _write_chunks(
    chunks: DataFrame, path: str, date: str, grain: str, format: str, mode: str, **options
) -> None:
    column = f"chunk_{grain}"
    ordered = chunks.hint("rebalance", column).sortWithinPartitions(column, date)
    writer = ordered.write.mode(mode).options(**options).partitionBy(column)
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def chunk_manifest(df: DataFrame, sums: Sequence[str] = (), date: str = "event_date", grain: str = "year") -> DataFrame:
    """One row per chunk: its period as text (null for rows without a date), `row_count` and
    the sum of each column of `sums`, in whole millionths, so that the order of adding
    makes no difference. One grouping, combined map side."""
    column = f"chunk_{grain}"
    totals = [F.sum(parts(c)).alias(f"sum_{c}") for c in sums]
    counted = _chunked(df, date, grain).groupBy(F.col(column).cast("string").alias(column))
    return counted.agg(F.count(F.lit(1)).alias("row_count"), *totals)


def refresh_chunks(
    df: DataFrame,
    path: str,
    periods: Sequence,
    sums: Sequence[str] = (),
    date: str = "event_date",
    grain: str = "year",
    format: str = "csv",
) -> DataFrame:
    """Write the chunks `periods` of `df` anew and leave the files of all others alone.

    Only rows of these periods are shuffled; the written directories replace their former
    ones when the job commits. A period without rows in `df` keeps its former files, since
    there is nothing to write there. Returns the manifest of what the chunks should hold, for `check_chunks`.
    """
    column = f"chunk_{grain}"
    chosen = _chunked(df, date, grain).where(F.col(column).isin(list(periods)))
    _write_chunks(chosen, path, date, grain, format, "overwrite", partitionOverwriteMode="dynamic")
    return chunk_manifest(chosen.drop(column), sums, date, grain)


def check_chunks(
    written: DataFrame, manifest: DataFrame, sums: Sequence[str] = (), date: str = "event_date", grain: str = "year"
) -> DataFrame:
    """Chunks of which `written`, the files read again, has other rows or sums than `manifest`
    says: the period, and each figure as `expected_…` and `found_…`. No rows: all is there."""
    column = f"chunk_{grain}"
    figures = ["row_count", *[f"sum_{c}" for c in sums]]
    expected = manifest.select(column, *[F.col(c).alias(f"expected_{c}") for c in figures])
    found = chunk_manifest(written, sums, date, grain).select(
        F.col(column).alias("__chunk"), *[F.col(c).alias(f"found_{c}") for c in figures]
    )
    differ = reduce(lambda a, b: a | b, [~F.col(f"expected_{c}").eqNullSafe(F.col(f"found_{c}")) for c in figures])
    return expected.join(found, F.col(column).eqNullSafe(F.col("__chunk")), "left").where(differ).drop("__chunk")


def export_product_pairs(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write product pairs as CSV, most frequent first."""
    write_csv(pairs.orderBy(F.col("pair_count").desc(), "product_a_id", "product_b_id"), path, mode)
