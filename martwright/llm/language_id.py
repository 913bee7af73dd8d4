"""Language identification by a convolutional network over bytes.

A window of bytes is embedded, filtered by convolutions of several widths, max-pooled over
the window and classified by a softmax layer. The network is trained here in numpy on
windows of labelled texts and applied to all fixed-length windows of every text, in
batches; a text gets the language with the highest mean log-probability over its windows.
Since a filter is linear in the embedded bytes, it is applied as sums of table rows: one
look-up for a pair of bytes instead of products for each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.shared import few_of_each

WIDTHS = (2, 3, 4)
PAD = 0  # a zero byte, embedded as zeros


@dataclass(frozen=True)
class Network:
    languages: tuple[str, ...]
    window: int
    tables: tuple[np.ndarray, ...]  # for each width: (width, 256, filters)
    bias: np.ndarray  # (widths, filters)
    out: np.ndarray  # (widths * filters, languages)
    out_bias: np.ndarray

    def pairs(self) -> tuple[list[np.ndarray], ...]:
        """For each width the tables of two bytes at a time, and of a last single one."""
        made = []
        for t in self.tables:
            two = [(t[j][:, None] + t[j + 1][None]).reshape(65536, -1) for j in range(0, len(t) - 1, 2)]
            made.append(two + ([t[-1]] if len(t) % 2 else []))
        return tuple(made)


def windows_of(data: bytes, window: int) -> np.ndarray:
    """All windows of a text, one after the other; the last one starts so that it ends with
    the text, and a short text is padded."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= window:
        return np.pad(raw, (0, window - len(raw)))[None]
    whole = len(raw) // window
    out = raw[: whole * window].reshape(whole, window)
    return np.concatenate([out, raw[None, -window:]]) if len(raw) % window else out


def log_chances(net: Network, pairs: tuple[list[np.ndarray], ...], windows: np.ndarray) -> np.ndarray:
    """(windows, languages) log-probabilities."""
    wide = windows.astype(np.int32)
    two = (wide[:, :-1] << 8) | wide[:, 1:]
    pooled = []
    for k, (t, tables) in enumerate(zip(net.tables, pairs, strict=True)):
        n = windows.shape[1] - len(t) + 1
        total = tables[0][two[:, :n]]
        for j, table in enumerate(tables[1:], 1):
            total += table[two[:, 2 * j : 2 * j + n] if len(table) > 256 else wide[:, 2 * j : 2 * j + n]]
        pooled.append(np.maximum(total.max(1) + net.bias[k], 0))
    logits = np.concatenate(pooled, 1) @ net.out + net.out_bias
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def fit(
    windows: np.ndarray, target: np.ndarray, languages: list[str], filters: int = 12, dim: int = 8,
    epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3,
) -> Network:
    """Adam on the cross-entropy; only the position of each filter's maximum gets a gradient."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    emb = rng.normal(0, 0.5, (256, dim)).astype(f32)
    emb[PAD] = 0
    convs = [rng.normal(0, (w * dim) ** -0.5, (w * dim, filters)).astype(f32) for w in WIDTHS]
    bias = np.zeros((len(WIDTHS), filters), f32)
    out = rng.normal(0, 0.1, (len(WIDTHS) * filters, len(languages))).astype(f32)
    out_bias = np.zeros(len(languages), f32)
    params = [emb, *convs, bias, out, out_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = (len(target) / np.maximum(np.bincount(target, minlength=len(languages)), 1) / len(languages)).astype(f32)
    step = 0
    for _ in range(epochs if len(languages) > 1 else 0):
        for at in np.array_split(rng.permutation(len(target)), max(1, len(target) // batch)):
            x, y = windows[at].astype(np.int64), target[at]
            e = emb[x]
            pooled, where, columns = [], [], []
            for k, w in enumerate(WIDTHS):
                n = x.shape[1] - w + 1
                cols = np.concatenate([e[:, j : j + n] for j in range(w)], 2)
                z = cols @ convs[k]
                best = z.argmax(1)
                pooled.append(np.take_along_axis(z, best[:, None], 1)[:, 0] + bias[k])
                where.append(best)
                columns.append(cols)
            h = np.concatenate(pooled, 1)
            a = np.maximum(h, 0)
            logits = a @ out + out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= (weight[y] / len(y))[:, None]
            grads = [np.zeros_like(q) for q in params]
            grads[-2], grads[-1] = a.T @ p, p.sum(0)
            dh = (p @ out.T) * (h > 0)
            for k, w in enumerate(WIDTHS):
                d = dh[:, k * filters : (k + 1) * filters]
                picked = columns[k][np.arange(len(y))[:, None], where[k]]  # (batch, filters, w * dim)
                grads[1 + k] = np.einsum("bfd,bf->df", picked, d)
                grads[-3][k] = d.sum(0)
                de = (d[:, :, None] * convs[k].T[None]).reshape(len(y), filters, w, dim)
                for j in range(w):
                    byte = np.take_along_axis(x, where[k] + j, 1)
                    np.add.at(grads[0], byte.ravel(), de[:, :, j].reshape(-1, dim))
            grads[0][PAD] = 0
            step += 1
            for q, g, a1, a2 in zip(params, grads, m, v, strict=True):
                a1 += 0.1 * (g - a1)
                a2 += 0.001 * (g * g - a2)
                q -= (rate * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.999**step)) + 1e-8)).astype(f32)
    tables = tuple(np.stack([emb @ c[j * dim : (j + 1) * dim] for j in range(w)]) for w, c in zip(WIDTHS, convs, strict=True))
    return Network(tuple(languages), windows.shape[1], tables, bias, out, out_bias)


def held_out(fold: int = 2, folds: int = 4):
    """Documents not learned from, by crc32 of the doc_id as text. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, window: int = 128, per_language: int = 600, windows_each: int = 4, max_languages: int = 200, rows_each: int = 4, **settings) -> Network | None:
    """Fit on at most `per_language` documents of each language that are not held out,
    chosen by a hash of their id, and `windows_each` windows of each, from anywhere in the
    text. Of a repeated id at most `rows_each` rows are used. Null languages and texts without letters are not learned from. None, if that
    leaves nothing. More than `max_languages` languages are an error."""
    usable = docs.where(~held_out()).where("lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}"))
    usable = usable.select("doc_id", "text", "lang")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(2**20)) / 2**20
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.5 * per_language / r["n"] + 40 / r["n"]))])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, lang in batch.itertuples(index=False):
                every = windows_of(text.encode("utf-8"), window)
                rng = np.random.default_rng(zlib.crc32(str(doc_id).encode()))
                for k in rng.choice(len(every), min(windows_each, len(every)), replace=False):
                    rows.append((doc_id, lang, int(k), every[k].tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "k", "w"])

    chosen = few_of_each(usable.where(salt < share[F.col("lang")]), rows_each)
    cuts = chosen.mapInPandas(cut, "doc_id long, lang string, k int, w binary").collect()
    by: dict[str, list] = {}
    for r in sorted(cuts, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["k"], r["w"])):
        by.setdefault(r["lang"], []).append(np.frombuffer(r["w"], np.uint8))
    languages = sorted(by)
    kept = [by[lang][: per_language * windows_each] for lang in languages]
    target = np.concatenate([np.full(len(x), k) for k, x in enumerate(kept)])
    return fit(np.concatenate([np.stack(x) for x in kept]), target, languages, **settings)


def identify(docs: DataFrame, net: Network | None, batch: int = 1024) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the chance of that language) of every document.

    Every window of every text is read, `batch` windows at a time. A text that is null or
    has no letter is `und` with score 0, and so is every text if there is no network.
    Equal chances go to the language first in the alphabet. Repeated rows are repeated.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)  # fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        pairs = model.pairs() if model else ()
        for frame in batches:
            total: dict[int, np.ndarray] = {}
            seen: dict[int, int] = {}
            waiting: list[np.ndarray] = []
            owner: list[int] = []

            def flush(total=total, waiting=waiting, owner=owner):
                if waiting:
                    chances = log_chances(model, pairs, np.stack(waiting))
                    for k, c in zip(owner, chances, strict=True):
                        total[k] = total.get(k, 0) + c
                    waiting.clear()
                    owner.clear()

            for k, text in enumerate(frame["text"]):
                if model and text and any(map(str.isalpha, text)):
                    every = windows_of(text.encode("utf-8"), model.window)
                    seen[k] = len(every)
                    for w in every:
                        waiting.append(w)
                        owner.append(k)
                        if len(waiting) >= batch:
                            flush()
            flush()
            predicted, chance = ["und"] * len(frame), [0.0] * len(frame)
            for k, c in total.items():
                mean = c / seen[k]
                best = int(mean.argmax())
                predicted[k] = model.languages[best]
                chance[k] = float(1 / np.exp(mean - mean[best]).sum())
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "held_out": frame["held_out"], "lang_pred": predicted, "score": chance})

    rows = docs.select(docs["doc_id"].cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
