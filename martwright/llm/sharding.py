"""Sharding by a Feistel permutation of global row numbers.

Every row gets a number from 0 to n-1 that depends on the rows alone, not on files,
partitions or the cluster. A Feistel network permutes these numbers; where it leads
outside 0..n-1 it is applied again (cycle walking), so it stays a permutation. Shard and
slot are remainder and quotient of the permuted number: shards differ by one row at most,
slots have no gaps, and anyone who knows n, the seed and a row number can compute both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
BLOCK = 10_000  # copies of one row that are numbered together
KEY = ("doc_id", "size", "text_crc32", "text_hash")


def _round_keys(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, ROUNDS, dtype=np.uint64)


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The permutation of 0..n-1 at `numbers`. The network works on the least even number
    of bits that holds n, so fewer than four steps are expected for each number."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = np.asarray(numbers).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for key in _round_keys(seed):
            left, right = right, left ^ (_mix(right, key) & mask)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _permuted(number: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def step(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(permute(numbers.to_numpy(), n, seed))

    return step(number)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        "text",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )


def _numbered(docs: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """Distinct rows with their `first` global number and `copies`, and the number of rows.

    Equal rows are counted first, so a row that is repeated without end is one row here.
    Distinct rows fall into hash buckets, are numbered within them and moved up by the
    rows in the buckets before; only the bucket totals, at most `buckets`, reach the driver.
    """
    spark = docs.sparkSession
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int").alias("bucket")
    rows = _keyed(docs).groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies")).select("*", bucket)
    totals = {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.sum("copies").alias("n")).collect()}
    offsets, n = [], 0
    for b in sorted(totals):
        offsets.append((b, n))
        n += totals[b]
    before = F.broadcast(spark.createDataFrame(offsets, "b int, offset long"))  # at most `buckets` rows
    order = Window.partitionBy("bucket").orderBy(*[F.col(k).asc_nulls_first() for k in KEY])
    running = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    numbered = rows.select("*", running.alias("within")).join(before, F.col("bucket") == F.col("b"))
    return numbered.select(*KEY, "copies", (F.col("within") + F.col("offset")).alias("first")), n


def _placed(numbered: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    # A row's copies in blocks first, dealt anew where there is more than one: no array is
    # longer than a block, or than the number of blocks, and no task makes all of them.
    blocks = numbered.withColumn("from", F.explode(F.expr(f"sequence(first, first + copies - 1, {BLOCK}L)")))
    few, many = blocks.where(F.col("copies") <= BLOCK), blocks.where(F.col("copies") > BLOCK)
    dealt = few.unionByName(many.repartition(F.xxhash64("from")))
    each = dealt.withColumn("number", F.explode(F.expr(f"sequence(from, least(from + {BLOCK - 1}L, first + copies - 1))"))).drop("from")
    moved = each.withColumn("place", _permuted(F.col("number"), n, seed))
    return moved.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).withColumn(
        "slot", F.floor(F.col("place") / shards).cast("long")
    )


def shard(docs: DataFrame, shards: int = 40, seed: int = 42, buckets: int = 2048) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, number.

    The law is `rows`. A null text counts as empty (size 16, crc32 0), a null doc_id is a
    value like any other; equal rows get neighbouring numbers before the permutation, and
    which of them gets which slot makes no difference. An empty table gives no rows; other
    columns are not read.
    """
    numbered, n = _numbered(docs, buckets)
    return _placed(numbered, n, shards, seed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "number",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 42, buckets: int = 2048) -> None:
    """Write doc_id and text as Parquet, a folder per shard, rows in order of their slot."""
    numbered, n = _numbered(docs, buckets)
    texts = _keyed(docs).groupBy(*KEY).agg(F.first("text").alias("text"))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"k.{k}")) for k in KEY]
    rows = texts.alias("t").join(numbered.alias("k"), same).select("k.*", "t.text")
    placed = _placed(rows, n, shards, seed)
    (
        placed.select("doc_id", "text", "shard", "slot")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
