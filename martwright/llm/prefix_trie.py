"""The trie of conversation prefixes, from whole sequences instead of single nodes.

Every conversation becomes a chain of 128-bit keys, one for each prefix: the key of a
prefix is the BLAKE2b hash of the key before it and of the digest of its last turn.
Conversations are streamed through a task in sorted order for that, so a task holds a batch of turns
however long a conversation is, and no text leaves the task that reads it: a turn is its
digest and its length from there on.

Conversations with the same last key are identical. They collapse into one weighted
sequence, kept by its smallest conversation, with the list of those that end there.
Sequences whose last key is a proper prefix of another one go in an anti-join; the others
are the leaves. The prefixes of the sequences, weighted, are aggregated to nodes map-side
first, so a root or a first turn that a third of all conversations share costs a row for
each task.

Sums over a subtree need no descent. With w the weight of a sequence s, and tail(s, d) the
bytes of its turns from the d-th on, the sum of members times bytes over the subtree of a
node at depth d is the sum of w * tail(s, d) over the sequences through it. For the bytes
of distinct nodes each node counts for one sequence, that of its smallest conversation:
the nodes that count for s are the tail of its path, because members only get fewer on
the way down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.shared import saved

HEADS = 9  # conversations take over 0 to 8 turns
FAMILY = 5
ENDS = 4096  # ids in a row of an end list

_CHAIN = "conv_id long, depth long, hi long, lo long, parent_hi long, parent_lo long, bytes long, cum long, ends boolean"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (1 for the first turn), digest and bytes of each turn, ordered by turn,
    null first, and by digest where turns are equal."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The role's length in front keeps ("ab", "c") and ("a", "bc") apart.
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.md5(whole.cast("binary"))).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "bytes")


def taken_over(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations: conv_id, pos, digest, bytes; and a row with pos 0
    for every conversation, which keeps those without any turn.

    A conversation c has the first h turns of conversation c - c % 5, and its own from
    the h + 1st on. Only the first turns of families, eight at most, are multiplied.
    """
    own = saved(turns(conversations))
    ids = own.where("pos = 1").select("conv_id")
    first = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS))
    near = F.transform(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1)), lambda k: F.try_add("conv_id", k))
    of_base = F.filter(near, lambda c: c - c % FAMILY == F.col("conv_id"))
    heads = first.select(F.explode(of_base).alias("conv_id"), "pos", "digest", "bytes").where(
        F.col("pos") <= taken_over(F.col("conv_id"))
    )
    heads = heads.join(ids, "conv_id", "left_semi")
    tails = own.where(F.col("pos") > taken_over(F.col("conv_id")))
    roots = ids.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return roots.unionByName(heads).unionByName(tails)


def chains(rows: DataFrame) -> DataFrame:
    """A row for each prefix of each conversation of `rows` (see `rebuilt`): its depth, its
    key and its parent's, bytes of the last turn and of all its turns, and whether the
    conversation ends there."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, whose `ends` the next row decides
        conv, key, depth, cum = None, b"", 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            size = batch.column("bytes").to_numpy(zero_copy_only=False)
            keys, parents = [], []
            depths, cums = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
            for k, (c, d) in enumerate(zip(ids.tolist(), batch.column("digest").to_pylist(), strict=True)):
                if c != conv:
                    conv, parent, key, depth, cum = c, b"\0" * 16, b"\0" * 16, 0, 0
                else:
                    parent, key, depth, cum = key, hashlib.blake2b(key + d, digest_size=16).digest(), depth + 1, cum + int(size[k])
                keys.append(key)
                parents.append(parent)
                depths[k], cums[k] = depth, cum
            made = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            above = np.frombuffer(b"".join(parents), "<i8").reshape(-1, 2)
            columns = [ids, depths, made[:, 0], made[:, 1], above[:, 0], above[:, 1], size, cums]
            names = ["conv_id", "depth", "hi", "lo", "parent_hi", "parent_lo", "bytes", "cum"]
            table = pa.table([pa.array(np.ascontiguousarray(x)) for x in columns], names)
            if held is not None:
                table = pa.concat_tables([held, table])
            all_ids = table.column("conv_id").to_numpy()
            done = table.slice(0, len(table) - 1)
            yield from done.append_column("ends", pa.array(all_ids[:-1] != all_ids[1:])).to_batches()
            held = table.slice(len(table) - 1).combine_chunks()
        if held is not None:
            yield from held.append_column("ends", pa.array([True])).to_batches()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(links, _CHAIN)


def _end_lists(ending: DataFrame) -> DataFrame:
    """hi, lo and the SHA-256 of the ids of the conversations that end there, in numerical
    order and comma-joined. Ids are joined in rows of at most ENDS, and these are hashed
    one after the other, so the list is never held."""
    block = F.floor(F.col("conv_id") / ENDS).alias("block")
    part = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = ending.groupBy("hi", "lo", block).agg(part.alias("part"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for hi, lo, text in zip(*[batch.column(n).to_pylist() for n in ("hi", "lo", "part")], strict=True):
                if (hi, lo) == at:
                    state.update(b"," + text.encode())
                    continue
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (hi, lo), hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["hi", "lo", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*at, state.hexdigest())], ["hi", "lo", "ends_sha256"])

    return (
        parts.repartition("hi", "lo")
        .sortWithinPartitions("hi", "lo", "block")
        .select("hi", "lo", "part")
        .mapInArrow(hashed, "hi long, lo long, ends_sha256 string")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, a null turn comes first, turns with equal numbers are
    ordered by their digest, repeated rows are turns of their own. Rows without a conv_id
    belong to no conversation and are left out. An empty table gives no rows, not even a
    root; other columns are not read. Two sequences are one if their 128-bit keys are.
    """
    key = ["hi", "lo"]
    chain = saved(chains(rebuilt(conversations)))
    ending = chain.where("ends")
    sequences = saved(
        ending.groupBy(*key).agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.max("cum").alias("total"))
    )
    prefixes = saved(
        chain.join(sequences.select(F.col("least").alias("conv_id"), "weight", "total"), "conv_id").select(
            "conv_id", "depth", *key, "parent_hi", "parent_lo", "bytes", "ends", "weight",
            (F.col("total") - F.col("cum") + F.col("bytes")).alias("tail"),
        )
    )
    proper = prefixes.where("not ends").select(*key).distinct()
    leaves = sequences.join(proper, key, "left_anti").select(F.col("least").alias("conv_id"), F.lit(1).alias("leaf"))
    nodes = saved(
        prefixes.groupBy(*key).agg(
            F.min("conv_id").alias("conv_id"),
            F.min("depth").alias("depth"),
            F.min("parent_hi").alias("parent_hi"),
            F.min("parent_lo").alias("parent_lo"),
            F.min("bytes").alias("bytes"),
            F.sum("weight").alias("n_convs"),
            F.sum(F.col("weight") * F.col("tail")).alias("spent"),
        )
    )
    counted = nodes.groupBy("conv_id").agg(F.min("depth").alias("counts_from"), F.sum("bytes").alias("counted"))
    marks = sequences.select(F.col("least").alias("conv_id")).join(leaves, "conv_id", "left").join(counted, "conv_id", "left")
    once = (
        F.when(F.col("counts_from").isNull(), 0).when(F.col("depth") >= F.col("counts_from"), F.col("tail")).otherwise(F.col("counted"))
    )
    sums = (
        prefixes.join(marks, "conv_id")
        .groupBy(*key)
        .agg(F.count("leaf").alias("n_leaves"), F.sum(once).alias("once"))
    )
    below = nodes.where("depth > 0")
    children = below.groupBy(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    named = nodes.select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("parent_conv_id"))
    parents = below.join(named, ["parent_hi", "parent_lo"]).select(*key, "parent_conv_id")
    return (
        nodes.join(sums, key)
        .join(children, key, "left")
        .join(parents, key, "left")
        .join(_end_lists(ending), key, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            "n_leaves",
            (F.col("spent") - F.col("once")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
