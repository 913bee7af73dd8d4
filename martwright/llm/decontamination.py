"""Benchmark decontamination with a positional inverted index of the corpus.

The index is split by document: for each document it stores, for every term that some
benchmark item uses, the sorted positions of that term. It is a table on shared storage.
A window of benchmark words is then looked up as in a phrase search: its terms are put in
order of their corpus frequency, the postings of the rarest one propose places, and the
lists of the others, each moved back by the term's offset in the window, are intersected
with them, next rarest first. Few places pass the first two lists, so common words are
hardly ever touched. Nothing is shuffled: the postings of one document lie in one row.

The benchmark is held by every task, in slices of at most `slice_words` words. A larger
benchmark takes several passes over the corpus, one per slice, instead of more memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.shared import alnum_words, saved

#: Words on either side of a window's rarest one within which a proximity match has all others:
#: any exact match of ten words is one too.
SLACK = 12

INDEX = "row long, doc_id long, n_words long, terms binary, starts binary, positions binary"
HITS = "row long, doc_id long, n_words long, hits binary, items array<string>, near array<string>"
RESULT = (
    "row long, doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, n_near_items long"
)


class Windows:
    """Windows of one slice of the benchmark, as arrays: `terms` (windows x width, term
    numbers, -1 beyond a short item's end), `size` and `item`."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        vocabulary: dict[bytes, int] = {}
        rows: dict[tuple, None] = {}
        self.items = sorted({i for i, _ in items if i is not None})
        number = {i: k for k, i in enumerate(self.items)}
        for item, words in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
            for at in range(max(1, len(ids) - width + 1) if ids else 0):
                rows[(number.get(item, -1), *ids[at : at + width])] = None
        self.vocabulary, self.width = vocabulary, width
        self.terms = np.full((len(rows), width), -1, np.int64)
        self.item = np.array([r[0] for r in rows], np.int64)
        self.size = np.array([len(r) - 1 for r in rows], np.int64)
        for k, r in enumerate(rows):
            self.terms[k, : len(r) - 1] = r[1:]

    def ordered(self, frequency: np.ndarray) -> None:
        """Fix for each window the order of its offsets, rarest term first, and list the
        windows by their rarest term."""
        by = np.where(self.terms >= 0, np.append(frequency, 0)[self.terms], np.iinfo(np.int64).max)
        self.order = np.argsort(by, axis=1, kind="stable") if len(by) else by
        rarest = self.terms[np.arange(len(self.terms)), self.order[:, 0]] if len(by) else np.zeros(0, np.int64)
        self.by_rarest = np.argsort(rarest, kind="stable")
        self.first = np.searchsorted(rarest[self.by_rarest], np.arange(len(self.vocabulary) + 1))


def _postings(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Terms of a document, where each one's list starts, and the lists."""
    where = np.flatnonzero(ids >= 0)
    order = where[np.argsort(ids[where], kind="stable")]
    terms, starts = np.unique(ids[order], return_index=True)
    return terms.astype("<i4").tobytes(), starts.astype("<i4").tobytes(), order.astype("<i4").tobytes()


def build_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Positional postings of each document for the terms of `vocabulary`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, doc_id, text in batch.itertuples(index=False):
                words = alnum_words(text)
                ids = np.fromiter((vocabulary.get(w, -1) for w in words), np.int64, len(words))
                rows.append((row, None if pd.isna(doc_id) else int(doc_id), len(words), *_postings(ids)))
            frame = pd.DataFrame(rows, columns=["row", "doc_id", "n_words", "terms", "starts", "positions"])
            yield frame.astype({"row": "Int64", "doc_id": "Int64"})

    return docs.select("row", docs["doc_id"].cast("long"), "text").mapInPandas(run, INDEX)


def document_frequency(index: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term occurs, over the whole index."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms in batch["terms"]:
                total[np.frombuffer(terms, "<i4")] += 1
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"term": seen, "n": total[seen]})

    out = np.zeros(n_terms, np.int64)
    for r in index.select("terms").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]  # at most `slice_words` rows
    return out


def search(index: DataFrame, windows: Windows, slack: int | None = None) -> DataFrame:
    """Words inside an exact occurrence of a window, as packed bits, the items of these
    windows, and the items with a proximity match: all words of a window within `slack`
    words on either side of its rarest one, in any order."""
    block = 256  # documents whose postings are intersected together

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.iloc[at : at + block]
                yield _search(part, windows, slack).astype({"row": "Int64", "doc_id": "Int64"})

    return index.mapInPandas(run, HITS)


def _search(part: pd.DataFrame, w: Windows, slack: int | None) -> pd.DataFrame:
    # All documents of the block on one line of positions, far enough apart.
    gap = w.width + 2 * (slack or 0)
    lengths = part["n_words"].to_numpy(np.int64)
    base = np.concatenate([[0], np.cumsum(lengths + gap)]) + gap
    span = np.int64(base[-1] + gap)
    terms, places = [], []
    for k, (t, s, p) in enumerate(zip(part["terms"], part["starts"], part["positions"], strict=True)):
        positions = np.frombuffer(p, "<i4").astype(np.int64)
        starts = np.frombuffer(s, "<i4")
        counts = np.diff(np.append(starts, len(positions)))
        terms.append(np.repeat(np.frombuffer(t, "<i4").astype(np.int64), counts))
        places.append(positions + base[k])
    term, place = np.concatenate(terms), np.concatenate(places)
    keys = np.sort(term * span + place)  # the block's postings: by term, then position
    hit = np.zeros(span, bool)
    exact: set[tuple[int, int]] = set()
    near: set[tuple[int, int]] = set()
    which = lambda at: np.searchsorted(base, at, "right") - 1
    if len(keys):
        # Every posting of a rarest term, with every window it is the rarest of.
        term, place = keys // span, keys % span
        n = w.first[term + 1] - w.first[term]
        order = np.concatenate([[0], np.cumsum(n)])
        step = 1 << 20  # proposals at once
        for lo in range(0, len(keys), 1 << 16):
            hi = min(lo + (1 << 16), len(keys))
            for a in range(order[lo], order[hi], step):
                number = np.arange(a, min(a + step, order[hi]))
                post = np.searchsorted(order, number, "right") - 1
                window = w.by_rarest[w.first[term[post]] + number - order[post]]
                start = place[post] - w.order[window, 0]
                close = np.arange(len(window))
                for j in range(1, w.width):  # exact: the lists moved by their offsets
                    offset = w.order[window, j]
                    other = w.terms[window, offset]
                    wanted = other * span + start + offset
                    found = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
                    kept = found | (other < 0)
                    window, start = window[kept], start[kept]
                for s, size in zip(start, w.size[window], strict=True):
                    hit[s : s + size] = True
                exact.update(zip(which(start).tolist(), w.item[window].tolist(), strict=True))
                if slack is None:
                    continue
                window = w.by_rarest[w.first[term[post]] + number - order[post]]
                anchor = place[post]
                for j in range(1, w.width):  # proximity: any posting close by
                    other = w.terms[window[close], w.order[window[close], j]]
                    lowest = other * span + anchor[close] - slack
                    found = keys[np.minimum(np.searchsorted(keys, lowest), len(keys) - 1)]
                    close = close[(other < 0) | ((found >= lowest) & (found <= lowest + 2 * slack))]
                near.update(zip(which(anchor[close]).tolist(), w.item[window[close]].tolist(), strict=True))
    by_doc: dict[str, dict[int, list[str]]] = {"exact": {}, "near": {}}
    for kind, pairs in (("exact", exact), ("near", near)):
        for d, i in pairs:
            if i >= 0:
                by_doc[kind].setdefault(d, []).append(w.items[i])
    return pd.DataFrame(
        {
            "row": part["row"].to_numpy(),
            "doc_id": part["doc_id"].to_numpy(),
            "n_words": lengths,
            "hits": [np.packbits(hit[b : b + n]).tobytes() if (n and hit[b : b + n].any()) else b"" for b, n in zip(base, lengths, strict=False)],
            "items": [sorted(by_doc["exact"].get(k, [])) for k in range(len(part))],
            "near": [sorted(by_doc["near"].get(k, [])) for k in range(len(part))],
        }
    )


def _summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            hits = b""
            for h in r.hits:  # one for each slice of the benchmark
                if h:
                    hits = bytes(np.bitwise_or(np.frombuffer(h, np.uint8), np.frombuffer(hits or bytes(len(h)), np.uint8)))
            n_hit = int(np.unpackbits(np.frombuffer(hits, np.uint8)).sum()) if hits else 0
            items = sorted({i for part in r.items for i in part})
            near = {i for part in r.near for i in part}
            digest = hashlib.sha256(",".join(items).encode()).hexdigest()
            doc_id = None if pd.isna(r.doc_id) else int(r.doc_id)
            rows.append((r.row, doc_id, r.n_words, n_hit, len(items), digest, n_hit > 0, items, len(near)))
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.replace("array<string>", "a").split(", ")])
        yield frame.astype({"row": "Int64", "doc_id": "Int64"})


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slack: int | None = None, slice_words: int = 1_000_000, number: str | None = None) -> DataFrame:
    """One row per document of `docs` (doc_id, text; other columns are not read): n_words,
    n_hit, n_items, items_sha256, contaminated, items and n_near_items.

    An item (item_id, text) of fewer than `width` words, but not none, is one window. Null
    texts have no words. A null doc_id is kept; windows of an item without id hit words but
    name no item. Repeated documents are repeated, repeated items count once. An empty
    corpus gives no rows, an empty benchmark rows without hits. Proximity matches are sought
    where `slack` is given.

    `number` names a column of `docs` that numbers its rows for good; the result carries it
    as `row`. Without one, a benchmark of several slices has the documents numbered and
    saved first.
    """
    docs = docs.select((F.col(number) if number else F.lit(None).cast("long")).alias("row"), "doc_id", "text")
    parts = []
    slices = _slices(benchmark, slice_words)
    items, following = next(slices), next(slices, None)
    if following is not None and not number:
        docs = saved(docs.withColumn("row", F.monotonically_increasing_id()))
    while items is not None:
        windows = Windows(items, width)
        index = saved(build_index(docs, windows.vocabulary))
        windows.ordered(document_frequency(index, len(windows.vocabulary)))
        parts.append(search(index, windows, slack))
        items, following = following, next(slices, None)
    found = ("hits", "items", "near")
    if len(parts) == 1:
        gathered = parts[0].select("row", "doc_id", "n_words", *[F.array(c).alias(c) for c in found])
    else:
        every = reduce(DataFrame.unionByName, parts)
        gathered = every.groupBy("row", "doc_id", "n_words").agg(*[F.collect_list(c).alias(c) for c in found])
    return gathered.mapInPandas(_summary, RESULT)


def _slices(benchmark: DataFrame, slice_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items with their words, in slices of about `slice_words` words; one at least.
    Rows stream to the driver partition by partition; only a slice is held."""
    part: list[tuple[str | None, list[bytes]]] = []
    held, any_yet = 0, False
    for r in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = alnum_words(r["text"])
        part.append((r["item_id"], words))
        held += len(words)
        if held >= slice_words:
            yield part
            part, held, any_yet = [], 0, True
    if part or not any_yet:
        yield part


def without_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """`docs` without those that hold an exact window of the benchmark, columns as they are.

    Documents are numbered in a table on shared storage, so repeated rows and null ids
    are judged one by one.
    """
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c) for c in docs.columns]).alias("own")))
    found = contamination(rows.select("row", "own.doc_id", "own.text"), benchmark, number="row", **settings)
    return rows.join(found.where("contaminated").select("row"), "row", "left_anti").select("own.*")
