"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint of 64 bits is cut into m partitions with thresholds t_1..t_m that add up to
tau - m + 1, tau being the number of bits that may differ. Whatever two fingerprints within
tau differ in, in some partition i they differ in at most t_i bits (t_i = -1: the partition
isn't probed). Partitions group correlated bits, by the covariance of all fingerprints;
thresholds are unequal, chosen by dynamic programming on the candidates that each
partition would give, which are estimated from second-moment sketches of all fingerprints.

Fingerprints are then entered under the value of each partition, and probe it with that
value and its neighbours. Pairs that meet are verified on all bits. Where a value is
shared by too many for pairs, its fingerprints are linked through midpoints instead: two
of them are within two bits exactly if they have a common neighbour within one bit, and
all who share one are linked to the least of them. That loses no link, and takes a fixed
number of rows for each fingerprint, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.shared import connected_components, saved, space_words

BITS = 64
SEED = 42
SKETCH = 256  # counters of a second-moment sketch: errors of about 9 %
CHUNK = 1 << 14


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of `width` words, space-joined, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*[words[k:] for k in range(width)], strict=False) if len(words) >= width else [words]
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs), np.uint64)


def majority(hashes: np.ndarray) -> np.uint64:
    """Bits set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return np.uint64(int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big"))


def fingerprint(text: Column, width: int = 3) -> Column:
    """The fingerprint of a text as a signed long; 0 for a text without words."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = [majority(shingle_hashes(space_words(t), width)) for t in texts]
            yield pd.Series(np.array(made, np.uint64).view(np.int64))

    return fp(text)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and `fp`, the text's fingerprint."""
    return docs.select("doc_id", fingerprint(F.col("text"), width).alias("fp"))


# --- partitions and thresholds --------------------------------------------------------


def _bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)


def covariance(fps: DataFrame) -> np.ndarray:
    """Of the 64 bits over all fingerprints; each task sends 65 x 64 sums at most."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS + 2, BITS))
        for batch in batches:
            x = _bits_of(batch["fp"].to_numpy(np.int64))
            total[:BITS] += x.T @ x
            total[BITS] += x.sum(0)
            total[BITS + 1, 0] += len(x)
        yield pd.DataFrame({"cell": np.arange(total.size, dtype=np.int32), "n": total.ravel()})

    rows = fps.select("fp").mapInPandas(sums, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((BITS + 2) * BITS)
    for r in rows:
        total[r["cell"]] = r["n"]
    total = total.reshape(BITS + 2, BITS)
    n = max(total[BITS + 1, 0], 1.0)
    mean = total[BITS] / n
    return total[:BITS] / n - np.outer(mean, mean)


def grouped_bits(cov: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal size: each starts with the bit most correlated to any
    left, and takes the bit most correlated with those it has, one by one."""
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    strength = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(strength, 0)
    left = list(range(BITS))
    parts = []
    for k in range(m):
        size = len(left) // (m - k)
        part = [left[int(strength[np.ix_(left, left)].max(1).argmax())]]
        left.remove(part[0])
        while len(part) < size:
            best = left[int(strength[np.ix_(left, part)].sum(1).argmax())]
            part.append(best)
            left.remove(best)
        parts.append(sorted(part))
    return parts


def mask_of(bits: list[int]) -> int:
    """The bits as a signed long."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def second_moments(fps: DataFrame, masks: list[int]) -> np.ndarray:
    """For each mask, an estimate of the number of ordered pairs of fingerprints that are
    equal under it: sum of squared sketch counters over all fingerprints."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(masks), SKETCH), np.int64)
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for k, mask in enumerate(masks):
                h = (fp & np.uint64(mask & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
                cell = (h % np.uint64(SKETCH)).astype(np.int64)
                total[k] += np.bincount(cell, weights=np.where(h >> np.uint64(63), 1, -1), minlength=SKETCH).astype(np.int64)
        yield pd.DataFrame({"cell": np.arange(total.size, dtype=np.int32), "n": total.ravel()})

    rows = fps.select("fp").mapInPandas(sketch, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(masks) * SKETCH)
    for r in rows:
        total[r["cell"]] = float(r["n"])
    return (total.reshape(len(masks), SKETCH) ** 2).sum(1)


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds with the least total cost: costs[i][t + 1] is that of threshold t in
    partition i, and the thresholds add up to `budget`. Dynamic programming over the
    partitions; (cost, thresholds)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for (total, (cost, chosen)), (k, more) in product(best.items(), enumerate(own)):
            t = total + k - 1
            if t not in following or cost + more < following[t][0]:
                following[t] = (cost + more, [*chosen, k - 1])
        best = following
    return best[budget]


def plan(fps: DataFrame, tau: int = 2, parts: tuple[int, ...] = (2, 3), key_cost: float = 8.0) -> list[tuple[list[int], int]]:
    """Partitions with a threshold of 0 or 1 each, from the cheapest number of partitions.

    Costs are estimated over all fingerprints: the candidates of a threshold of 0 are the
    pairs equal in the partition, those of 1 also the pairs equal but for one bit;
    `key_cost` is the price of entering or probing a key, against 1 for a candidate.
    """
    cov = covariance(fps)
    layouts = {m: grouped_bits(cov, m) for m in parts}
    masks = [mask_of([b for b in bits if b != out]) for m in parts for bits in layouts[m] for out in (None, *bits)]
    moments = iter(second_moments(fps, masks).tolist())
    n = float(fps.count())
    options = []
    for m in parts:
        costs = []
        for bits in layouts[m]:
            equal = max(next(moments), n)
            but_one = [max(next(moments) - equal, 0.0) for _ in bits]
            pairs0 = (equal - n) / 2
            costs.append([0.0, n * key_cost + pairs0, n * key_cost * (2 + len(bits)) + pairs0 + sum(but_one) / 2])
        cost, thresholds = allocate(costs, tau - m + 1)
        options.append((cost, [(bits, t) for bits, t in zip(layouts[m], thresholds, strict=True) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


# --- candidates and links ---------------------------------------------------------------


def _variants(fp: Column, bits: list[int], own_mask: int) -> Column:
    """The value under the mask and all values with one of `bits` turned over."""
    value = fp.bitwiseAND(F.lit(own_mask))
    return F.array(value, *[value.bitwiseXOR(F.lit(mask_of([b]))) for b in bits])


def links(fps: DataFrame, tau: int = 2, dense: int = 200, chosen: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """(a, b) of distinct fingerprints `fp` that give the components of "at most `tau` bits
    differ": each pair holds, and every two fingerprints within `tau` are connected by
    pairs. Values shared by more than `dense` go through midpoints, which needs tau = 2."""
    if tau != 2:
        raise ValueError("midpoints are for tau = 2")
    chosen = plan(fps, tau) if chosen is None else chosen
    entered, probing = [], []
    for i, (bits, t) in enumerate(chosen):
        mask = mask_of(bits)
        entered.append(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value")))
        if t:
            probing.append((i, bits, mask))
    keys = fps.select("fp", F.explode(F.array(*entered)).alias("k")).select("fp", "k.part", "k.value")
    probes = keys
    for i, bits, mask in probing:
        near = fps.select("fp", F.lit(i).alias("part"), F.explode(F.slice(_variants(F.col("fp"), bits, mask), 2, len(bits))).alias("value"))
        probes = probes.unionByName(near)
    sizes = saved(keys.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")))
    met = probes.join(sizes, ["part", "value"])
    small = met.where((F.col("n") <= dense)).select(F.col("fp").alias("a"), "part", "value")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    verified = (
        small.join(keys.withColumnRenamed("fp", "b"), ["part", "value"])
        .where((F.col("a") != F.col("b")) & (differ <= tau))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    crowded = met.where(F.col("n") > dense).select("fp").distinct()
    return verified.union(_midpoints(crowded))


def _midpoints(fps: DataFrame) -> DataFrame:
    """Each fingerprint linked to the least one around every value within one bit of it."""
    around = fps.select("fp", F.explode(_variants(F.col("fp"), list(range(BITS)), -1)).alias("mid"))
    least = around.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("other")).where("b < other")
    return around.join(least, "mid").where("fp <> b").select(F.col("b").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, tau: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the
    smallest doc_id reachable over fingerprints that differ in at most `tau` bits.

    A-Z are lower-cased, words are runs without ASCII white space; a text of fewer than
    `width` words is one shingle; null, empty and blank texts have fingerprint 0 and are
    linked like any other. A null doc_id is kept and can't be a component's id, unless
    its component has no other (then null). Repeated rows are repeated. No documents give
    no rows; other columns are not read.
    """
    rows = saved(fingerprints(docs, width))
    ids = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))  # one row per fingerprint
    members = connected_components(links(ids.select("fp"), tau))
    known = ids.join(members.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component")
    )
    named = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_fp = known.select("fp", "component").join(named, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, tau: int = 2) -> DataFrame:
    """`docs` without all but one document of each component of `near_duplicates`: the
    smallest doc_id stays, of several rows with it the one whose text hashes lowest; a null
    doc_id counts as largest. Texts without words (null, empty, blank) have one fingerprint,
    so one of them stays. Rows that stay keep all columns. Empty in, empty out.

    Whole rows move once, behind the decision; components are found over distinct
    fingerprints, each with its least row, so a group of copies is one row there.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"))
    own = F.struct(*[F.col(c) for c in docs.columns])
    rows = saved(docs.select(F.monotonically_increasing_id().alias("uid"), fingerprint(F.col("text"), width).alias("fp"), rank.alias("rank"), own.alias("own")))
    least = saved(rows.groupBy("fp").agg(F.min_by("uid", F.struct("rank", "uid")).alias("uid"), F.min("rank").alias("rank")))
    members = connected_components(links(least.select("fp"), tau))
    placed = least.join(members.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    kept = placed.groupBy("component").agg(F.min_by("uid", F.struct("rank", "uid")).alias("uid")).select("uid")
    return rows.join(kept, "uid", "left_semi").select("own.*")
