"""Exact substring deduplication: depth-limited radix sort of suffixes.

Two places start the same window of `depth` tokens exactly if their suffixes are equal
through `depth` tokens. So suffixes are ordered by most significant digits and no further
than that; places whose digits are all equal form a group, and groups of two or more are
the repeated windows. To move far fewer digits than there are places:

* Neighbouring windows share their leading digit. Of the runs of `digit` tokens inside a
  window, the one with the least hash (the first of equals) is a function of the window's
  content, so equal windows choose equal runs at equal offsets. All consecutive windows
  that choose the same run make one row; there is about one for every (depth - digit) / 2
  tokens.
* First pass: rows are grouped by that run. A run that occurs once is done: none of its
  windows is repeated. This settles nearly all of a corpus.
* Second pass: rows are grouped by their whole content. If it occurs again, all of the
  row's windows are repeated.
* Third pass: what is left has a run in common with others but not the content, at the
  edges of repeated passages. There single windows are grouped, inside one task for
  the rows of a run, or over the cluster for a run with very many.

Texts are told apart by a digest, so copies are counted, not processed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.shared import saved

_STEP = 1 << 19  # windows handled at once
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GATHER = 4000  # rows of a run whose windows are grouped inside a task
BUCKET_ROWS = 4000  # rows that such a task gets
HANDED = 1 << 16  # rows or windows that a Python worker makes at a time
HELD = 1 << 22  # bytes of texts or tokens that it makes at a time


def tokens(data: bytes, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, where each token starts, where it ends) of a text's `bytes` or `words`."""
    if unit == "bytes":
        at = np.arange(len(data) + 1, dtype=np.int64)
        return np.frombuffer(data, np.uint8), at[:-1], at[1:]
    words = data.split()
    values = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    space = np.frombuffer(data, np.uint8)
    blank = np.concatenate([[True], (space == 0x20) | ((space >= 9) & (space <= 13)), [True]])
    edges = np.diff(blank.astype(np.int8))
    return values, np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _least_within(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, from running minima of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def rows_of(values: np.ndarray, depth: int, digit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, n, run and content of every row: `n` windows from `start` on, the hash of
    the run that they choose and of all their tokens."""
    parts = []
    windows = len(values) - depth + 1
    for at in range(0, max(windows, 0), _STEP):
        m = min(_STEP, windows - at)
        own = values[at : at + m + depth - 1]
        mixed = _BYTE[own] if own.dtype == np.uint8 else own
        up, down = _powers(_STEP + depth)
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(mixed * up[: len(own)], out=sums[1:])
        h = (sums[digit:] - sums[:-digit]) * down[: len(own) - digit + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        # Position in the low bits: the first of equal hashes is the least.
        ordered = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        chosen = (_least_within(ordered, depth - digit + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1])
        count = np.diff(np.append(first, m))
        raw, size = memoryview(np.ascontiguousarray(own).view(np.uint8)), own.itemsize
        content = np.fromiter(
            (xxhash.xxh3_64_intdigest(raw[s * size : (s + c + depth - 1) * size]) for s, c in zip(first.tolist(), count.tolist(), strict=True)),
            np.uint64,
            len(first),
        )
        parts.append((first + at, count, h[chosen[first]], content))
    if not parts:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing.astype(np.uint64), nothing.astype(np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals: touching and overlapping ones become one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if len(start) else np.zeros(0, np.int64)
    return start[new], end[np.append(new[1:] - 1, len(end) - 1)] if len(new) else end


ROWS = "uid binary, start int, n int, run long, content long, copies int"


def _scan(texts: DataFrame, depth: int, digit: int, unit: str) -> DataFrame:
    """Rows of all texts (uid, text). Contents that a text holds several times leave it
    once, with their number, and the windows they settle as rows with 0 copies."""

    def frame(uids: list[bytes], parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        columns = [np.concatenate(p) for p in zip(*parts, strict=True)]
        return pd.DataFrame({"uid": uids} | dict(zip(("start", "n", "run", "content", "copies"), columns, strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            uids, parts = [], []
            for uid, text in batch.itertuples(index=False):
                if len(uids) >= HANDED:
                    yield frame(uids, parts)
                    uids, parts = [], []
                start, n, runs, content = rows_of(tokens((text or "").encode("utf-8"), unit)[0], depth, digit)
                if not len(start):
                    continue
                _, at, group, copies = np.unique(runs ^ (content * np.uint64(_BASE)), return_index=True, return_inverse=True, return_counts=True)
                again = copies[group] > 1
                s, e = _merged(start[again], (start + n)[again])
                zero = np.zeros(len(s), np.int64)
                parts.append(
                    (
                        np.concatenate([start[at], s]),
                        np.concatenate([n[at], e - s]),
                        np.concatenate([runs[at].view(np.int64), zero]),
                        np.concatenate([content[at].view(np.int64), zero]),
                        np.concatenate([copies, zero]),
                    )
                )
                uids += [uid] * (len(at) + len(s))
            if parts:
                yield frame(uids, parts)

    return texts.select("uid", "text").mapInPandas(run, ROWS)


WINDOWS = "uid binary, start int, n int, run long, copies long, rows long, data binary"


def _fetched(asked: DataFrame, depth: int, unit: str) -> DataFrame:
    """The tokens of rows, from texts (uid, text, rows: array of start, n, run, copies, rows)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for uid, text, rows in batch.itertuples(index=False):
                values = tokens(text.encode("utf-8"), unit)[0]
                for r in rows:
                    data = values[r["start"] : r["start"] + r["n"] + depth - 1].tobytes()
                    out.append((uid, r["start"], r["n"], r["run"], r["copies"], r["rows"], data))
                    held += len(data)
                    if held >= HELD:
                        yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOWS.split(", ")])
                        out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOWS.split(", ")])

    return asked.select("uid", "text", "rows").mapInPandas(run, WINDOWS)


def _windows(data: bytes, n: int, depth: int, size: int) -> Iterator[int]:
    raw = memoryview(data)
    return (xxhash.xxh3_64_intdigest(raw[k * size : (k + depth) * size]) for k in range(n))


def _hashes(frame: pd.DataFrame, depth: int, size: int) -> np.ndarray:
    """Hashes of all windows of the rows of a frame, row by row."""
    own = (_windows(d, n, depth, size) for d, n in zip(frame["data"], frame["n"], strict=True))
    return np.fromiter(chain.from_iterable(own), np.uint64, int(frame["n"].sum()))


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes are HANDED together at most, or one of them alone."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HANDED, "right")))
        yield at, stop
        at = stop


def _again(frame: pd.DataFrame, depth: int, size: int) -> pd.DataFrame:
    """uid, start and n of the windows that occur again among those of the same run, of rows
    with one copy; neighbouring windows are one range."""
    n, run, copies = (frame[c].to_numpy(np.int64) for c in ("n", "run", "copies"))
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    hashes = _hashes(frame, depth, size)
    order = np.lexsort((hashes, run[row]))
    own, of = hashes[order], run[row[order]]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])]))
    total = np.add.reduceat(copies[row[order]], first)
    hit = np.empty(len(row), bool)
    hit[order] = np.repeat(total > 1, np.diff(np.append(first, len(row))))
    hit &= copies[row] == 1
    before = np.concatenate([[False], hit[:-1]]) & (offset > 0)
    after = np.concatenate([hit[1:], [False]]) & (offset < n[row] - 1)
    begin, end = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    at = row[begin]
    return pd.DataFrame({"uid": frame["uid"].to_numpy()[at], "start": frame["start"].to_numpy()[at] + offset[begin], "n": end - begin + 1})


def _edges(fetched: DataFrame, depth: int, unit: str) -> DataFrame:
    """(uid, start, n) of the repeated windows of rows that occur once themselves."""
    size = 1 if unit == "bytes" else 8

    def inside(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("run", kind="stable")
        run = frame["run"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))  # row of each run
        stop = np.append(first[1:], len(frame))
        windows = np.add.reduceat(frame["n"].to_numpy(np.int64), first)
        return pd.concat([_again(frame.iloc[first[a] : stop[b - 1]], depth, size) for a, b in _slices(windows)])

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in _slices(batch["n"].to_numpy(np.int64)):
                part = batch.iloc[a:b]
                n = part["n"].to_numpy(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                offset = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                columns = {c: part[c].to_numpy()[row] for c in ("uid", "start", "run", "copies")}
                columns["start"] = columns["start"] + offset
                yield pd.DataFrame(columns | {"window": _hashes(part, depth, size).view(np.int64)})

    few = fetched.where(F.col("rows") <= GATHER)
    buckets = 1 + few.count() // BUCKET_ROWS
    near = few.groupBy(F.pmod(F.xxhash64("run"), F.lit(buckets)).alias("bucket")).applyInPandas(inside, "uid binary, start int, n int")
    many = fetched.where(F.col("rows") > GATHER).mapInPandas(spread, "uid binary, start int, run long, copies long, window long")
    repeated = many.groupBy("run", "window").agg(F.sum("copies").alias("total")).where("total > 1").drop("total")
    far = many.where("copies = 1").join(repeated, ["run", "window"]).select("uid", "start", F.lit(1).alias("n"))
    return near.unionByName(far)


def digest(text: Column) -> Column:
    """96 bits of a text's MD5; null counts as empty."""
    return F.unhex(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 24))


CUT = "uid binary, n_removed long, n_spans long, kept_sha256 string, kept string"


def _cut(texts: DataFrame, depth: int, unit: str) -> DataFrame:
    """Results of texts (uid, text, ranges: array of start, n), with what is kept as text;
    a character of which some bytes are removed is not kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for uid, text, ranges in batch.itertuples(index=False):
                if held >= HELD:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in CUT.split(", ")])
                    out, held = [], 0
                data = text.encode("utf-8")
                _, starts, ends = tokens(data, unit)
                first = np.array([r["start"] for r in ranges], np.int64)
                last = first + np.array([r["n"] for r in ranges], np.int64) + depth - 2
                s, e = _merged(starts[first], ends[last])
                kept = [data[a:b] for a, b in zip([0, *e], [*s, len(data)], strict=True)]
                whole = b"".join(kept)
                held += len(whole)
                out.append(
                    (uid, len(data) - len(whole), len(s), hashlib.sha256(whole).hexdigest(), "".join(k.decode("utf-8", "ignore") for k in kept))
                )
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CUT.split(", ")])

    return texts.select("uid", "text", "ranges").mapInPandas(run, CUT)


def repeated(docs: DataFrame, depth: int = 400, unit: str = "bytes", digit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(uid and copies of each different text, results of the texts with repeated windows)."""
    digit = digit or depth // 2
    own = docs.select(digest(F.col("text")).alias("uid"), F.coalesce("text", F.lit("")).alias("text"))
    counts = own.groupBy("uid").agg(F.count(F.lit(1)).alias("copies"))
    scanned = _scan(own, depth, digit, unit)

    # First pass: runs that occur again, and their rows.
    again = scanned.where("copies > 0").groupBy("run").agg(F.sum("copies").alias("total")).where("total > 1").drop("total")
    local = scanned.where("copies = 0")
    rows = saved(scanned.where("copies > 0").join(again, "run").unionByName(local))
    classed = rows.where("copies > 0")

    # Second pass: contents that occur again; of each content one row stands for all.
    contents = saved(
        classed.groupBy("run", "content").agg(F.sum("copies").alias("copies"), F.min(F.struct("uid", "start", "n")).alias("first"))
    )
    whole = classed.join(contents.where("copies > 1").select("run", "content"), ["run", "content"]).select("uid", "start", "n")

    # Third pass: runs with several contents, one of which occurs once.
    mixed = (
        contents.groupBy("run")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("copies").alias("least"))
        .where("rows > 1 and least = 1")
        .select("run", "rows")
    )
    asked = contents.join(mixed, "run").select("first.uid", F.struct("first.start", "first.n", "run", "copies", "rows").alias("row"))
    asked = asked.groupBy("uid").agg(F.collect_list("row").alias("rows"))  # a text's own rows

    # The texts that have rows left, each once; copies are combined map-side.
    texts = own.groupBy("uid").agg(F.first("text").alias("text"))
    texts = saved(texts.join(rows.select("uid").distinct(), "uid", "left_semi"))
    fetched = saved(_fetched(texts.join(asked, "uid"), depth, unit))
    settled = rows.where("copies = 0").select("uid", "start", "n")
    ranges = settled.unionByName(whole).unionByName(_edges(fetched, depth, unit))
    ranges = ranges.groupBy("uid").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))  # a text's own
    return counts, _cut(texts.join(ranges, "uid"), depth, unit)


def _covered(docs: DataFrame, depth: int, unit: str, digit: int | None) -> DataFrame:
    """`own`: the row; and what `_cut` found for its text, or nulls."""
    _, cut = repeated(docs, depth, unit, digit)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("own"), digest(F.col("text")).alias("uid"))
    return rows.join(cut, "uid", "left")


def remove_repeats(docs: DataFrame, depth: int = 400, unit: str = "bytes", digit: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes (of the whole input text), n_removed, n_spans,
    kept_sha256 and `text`, what is left; of a character cut in the middle nothing is.

    Every byte that is part of `depth` tokens which also start somewhere else, in any
    document, is removed; overlaps count, and all is judged on the input. `unit` is `bytes`
    or `words` (of which the white space between two removed ones goes too). Null texts
    are empty. Null and repeated doc_ids stay as they are, a text of `depth` tokens that
    occurs twice is removed wholly. No documents give no rows; other columns are not read.
    """
    out = _covered(docs.select("doc_id", "text"), depth, unit, digit)
    text = F.coalesce("own.text", F.lit("")).cast("binary")
    return out.select(
        "own.doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.sha2(text, 256)).alias("kept_sha256"),
        F.coalesce("kept", "own.text", F.lit("")).alias("text"),
    )


def without_repeats(docs: DataFrame, depth: int = 400, unit: str = "bytes", digit: int | None = None) -> DataFrame:
    """`docs` with their texts cut as in `remove_repeats`, all columns kept; a text without
    repeats stays as it is, null too, and one that is nothing but repeats becomes empty."""
    out = _covered(docs, depth, unit, digit)
    return out.select(*[F.coalesce("kept", "own.text").alias("text") if c == "text" else F.col("own")[c].alias(c) for c in docs.columns])
