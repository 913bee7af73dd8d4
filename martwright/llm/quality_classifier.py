"""Quality classifier: a factorisation machine over words, structure and metadata.

Features are the hashed words of a text (weighted by log counts, of unit length), and a
few statistics of its structure and of its record. The machine scores
    w0 + <w,x> + 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
all pairwise interactions in time linear in the number of features. It is trained in
numpy on a sample of labelled documents, whose size is bounded by `max_labelled`, and
applied to every whole text; scoring shuffles nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.shared import few_of_each, space_words

STATISTICS = 16  # features after the hashed words
_SYMBOL = re.compile(rb"[#$%&*@^~|<>{}\\=+_]")
_REPEAT = re.compile(rb"([^0-9\s])\1\1")


@dataclass(frozen=True)
class Machine:
    """Weights of the hashed words and the statistics. `platt` maps raw scores to chances."""

    buckets: int
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, features: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([1 / (1 + math.exp(-max(-500.0, min(500.0, self.raw(i, x))))) for i, x in features])

    def raw(self, index: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[index] * x[:, None]
        pairs = (v.sum(0) ** 2 - (v**2).sum(0)).sum() / 2
        return float(self.bias + self.linear[index] @ x + pairs)


def features(text: str | None, n_chars: float | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one document; its whole text is read."""
    words = space_words(text)
    counts: Counter[int] = Counter()
    for word, n in Counter(words).items():
        counts[zlib.crc32(word) % buckets] += n
    index = np.fromiter(counts, np.int64, len(counts))
    x = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    x /= math.sqrt(float(x @ x)) or 1.0
    stats = _statistics(text or "", words, n_chars)
    return np.concatenate([index, buckets + np.arange(len(stats))]), np.concatenate([x, stats])


def _statistics(text: str, words: list[bytes], n_chars: float | None) -> np.ndarray:
    raw = text.encode("utf-8")
    n, chars = len(words) or 1, len(raw) or 1
    lines = [line for line in text.split("\n") if line.strip()]
    joined = sum(map(len, words)) or 1
    ends = sum(w.endswith((b".", b"!", b"?")) for w in words)
    told = 0.0 if n_chars is None or n_chars != n_chars else float(n_chars)
    values = (
        math.log1p(len(words)) / 10,
        math.log1p(len(lines)) / 5,
        joined / n / 20,
        len(set(words)) / n,
        len(set(lines)) / (len(lines) or 1),
        len(_SYMBOL.findall(raw)) / chars * 5,
        len(_REPEAT.findall(raw)) / n * 3,
        sum(c.isdigit() for c in map(chr, raw)) / chars * 5,
        sum(65 <= c <= 90 for c in raw) / chars * 5,
        ends / n * 3,
        sum(not w.isalnum() and w.isascii() for w in words) / n,
        max(Counter(words).values(), default=0) / n,
        len(max(words, key=len, default=b"")) / 100 if words else 0.0,
        float(not words),
        math.log1p(max(told, 0.0)) / 15,  # metadata: the length on record,
        float(told != len(text)),  # and whether the text has that length
    )
    return np.minimum(np.array(values), 3.0)


def held_out(fold: int = 1, folds: int = 3):
    """Documents that labels are not learned from: crc32 of the doc_id as text gives the fold.
    A null doc_id is not held out; it has no labels either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 4000,
    rows_each: int = 4,
    buckets: int = 1 << 15,
    rank: int = 8,
    epochs: int = 15,
    rate: float = 0.1,
    decay: float = 1e-5,
    seed: int = 7,
) -> Machine:
    """Fit on at most `max_labelled` labelled documents that are not held out, chosen by a
    hash of their id, and at most `rows_each` rows of a repeated id, chosen by a hash of their
    text. Texts are read whole; only their features reach the driver.

    Null labels and labels without a document are not used; a document with several has
    their least. Without labels of both kinds the machine scores 0.5 or its bias.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
        .select(F.col("doc_id").alias("labelled_id"), "quality")
    )
    # At most `max_labelled` rows of two numbers.
    own = docs.select("doc_id", "text", docs["n_chars"].cast("double"))
    rows = own.join(F.broadcast(chosen), own["doc_id"] == F.col("labelled_id")).select("doc_id", "text", "n_chars", "quality")
    rows = few_of_each(rows, rows_each)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [features(t, n, buckets) for t, n in zip(batch["text"], batch["n_chars"], strict=True)]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "quality": batch["quality"],
                    "i": [i.astype("<i4").tobytes() for i, _ in made],
                    "x": [x.astype("<f4").tobytes() for _, x in made],
                }
            )

    got = rows.mapInPandas(sparse, "doc_id long, quality int, i binary, x binary").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), bytes(r["x"])))  # the same order on any cluster
    made = [(np.frombuffer(r["i"], "<i4"), np.frombuffer(r["x"], "<f4").astype(np.float64)) for r in got]
    return fit(made, np.array([r["quality"] for r in got], np.float64), buckets, rank, epochs, rate, decay, seed)


def fit(made, target: np.ndarray, buckets: int, rank: int, epochs: int, rate: float, decay: float, seed: int) -> Machine:
    """AdaGrad on the logistic loss, one document at a time, both classes weighted alike."""
    rng = np.random.default_rng(seed)
    size = buckets + STATISTICS
    w0, w, v = 0.0, np.zeros(size), rng.normal(0, 0.01, (size, rank))
    g0, gw, gv = 1e-8, np.full(size, 1e-8), np.full((size, rank), 1e-8)
    n1 = float(target.sum())
    weight = {1.0: len(target) / (2 * max(n1, 1)), 0.0: len(target) / (2 * max(len(target) - n1, 1))}
    for _ in range(epochs if len(made) else 0):
        for d in rng.permutation(len(made)):
            i, x = made[d]
            vx = v[i] * x[:, None]
            s = vx.sum(0)
            raw = w0 + w[i] @ x + ((s**2).sum() - (vx**2).sum()) / 2
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, raw)))) - target[d]) * weight[target[d]]
            d0, dw, dv = error, error * x + decay * w[i], error * x[:, None] * (s - vx) + decay * v[i]
            g0 += d0 * d0
            gw[i] += dw * dw
            gv[i] += dv * dv
            w0 -= rate * d0 / math.sqrt(g0)
            w[i] -= rate * dw / np.sqrt(gw[i])
            v[i] -= rate * dv / np.sqrt(gv[i]) * 0.5
    return Machine(buckets, w0, w, v)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """`docs` with `score`, the chance of quality 1, and `predicted`, 1 from 0.5 on.

    Every document is scored by itself, over its whole text; null and empty texts by
    their statistics. Null `n_chars` counts as 0. Rows and other columns stay as they are,
    but for columns of these two names, which are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)  # buckets x (rank + 1) numbers, whatever the corpus

    @F.pandas_udf("double")
    def chance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = held.value
        for text, n_chars in batches:
            yield pd.Series([float(m.score([features(t, n, m.buckets)])[0]) for t, n in zip(text, n_chars, strict=True)])

    scored = docs.withColumn("score", chance(F.col("text"), F.col("n_chars").cast("double")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    machine = train(docs, labels, **settings)
    return score(docs.select("doc_id", "text", "n_chars"), machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that the machine doesn't reject, with their own columns."""
    machine = train(docs, labels, **settings)
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("own"))
    rated = score(own.select("own", "own.text", "own.n_chars"), machine)
    return rated.where("predicted = 1").select("own.*")
