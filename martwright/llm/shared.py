"""What several text operators need: tables on shared storage, words, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes that separate words of letters and digits, for `alnum_words`: everything in ASCII
#: but 0-9 and a-z once A-Z are lower-cased.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder, which all executors can reach.

    Only where the cluster names none, as in local tests, a folder of our own is set.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        context.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/martwright-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """`df` written to shared storage and read again: later steps start from the files,
    so a lost executor costs its own tasks only and nothing is computed twice."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; `lower` would change other letters too."""
    return F.translate(c, _UPPER, _UPPER.lower())


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8").translate(_ALNUM).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8").lower().split() if text else []


def few_of_each(docs: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of each doc_id of (doc_id, text, …), those whose text has the least
    hash. Spark keeps no more than these of a map task's rows before the shuffle, so an
    id on a large part of the table reaches one task as a few rows of each map task."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    return docs.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): the smallest node it can reach.

    Alternating large-star and small-star steps: each node's larger, then smaller
    neighbours are linked to the least node around it. Edges shrink to stars in about
    log(n) rounds, however long a chain is. A node's neighbours are never gathered: its
    minimum is a combined aggregate and the links are a join that AQE can split. Each
    round is cut off at a table on shared storage.

    Null nodes and loops carry no link and are left out. Raises if `rounds` do not do.
    """

    def star(links: DataFrame, both_ways: bool) -> DataFrame:
        pairs = links.select("a", "b")
        if both_ways:
            pairs = pairs.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = pairs.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("least"))
        least = least.select("hub", F.least("hub", "least").alias("m"))
        joined = pairs.join(least, F.col("a") == F.col("hub"))
        if both_ways:
            linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select(F.col("hub").alias("a"), F.col("m").alias("b"))
            )
        return linked.where("a <> b").distinct()

    def state(links: DataFrame) -> tuple:
        return tuple(
            links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )

    links = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(links)
    for _ in range(rounds):
        if not before[0]:
            break
        links = saved(star(star(links, True), False))
        now = state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
