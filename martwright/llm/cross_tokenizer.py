"""Alignment of two tokenizers' tokens by lockstep merging over byte offsets.

Both token sequences of a text cover the same bytes, so they can be merged like two sorted
lists of ends. All texts of a batch are merged at once: one NumPy vector holds a pointer
into the A tokens and one into the B tokens for each lane. In each step every lane emits
its link (the two tokens overlap), emits a cut if both end at the same byte, and advances
the pointer whose token ends first, or both. Finished lanes are dropped from the vector.
A text is one lane; a long one is several, each with STRETCH tokens of A, because the
state at any token of A is known: it overlaps the first B token that ends behind its
start. So the number of steps is bounded and does not follow the longest text.

How often an id pair is linked in the corpus is counted map-side first. To look the
counts up again the most frequent pairs, a table of at most FREQUENT rows, go to every
task; the other pairs, of which there may be any number, meet their counts in a shuffle.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.shared import saved

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
STRETCH = 256  # tokens of A in a lane
MERGED = 1 << 21  # characters merged together; a longer text is merged alone
ENCODED = 1 << 18  # characters given to a tokenizer together
WORDS = 200_000  # words that a Python worker remembers with their tokens,
WORD_CHARS = 1 << 22  # and their characters; beyond either it starts anew
FREQUENT = 1 << 18
#: A single space between other characters: neither tokenizer has a token across it, and what
#: follows is encoded as it is at the beginning of a text.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_known: dict[str, _Pair] = {}


class Tokens(NamedTuple):
    """Tokens of several texts behind one another: ids, bytes that each has, and where
    each text's tokens begin, with the total at the end."""

    ids: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray


# --- tokenizers ----------------------------------------------------------------------------


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies use for bytes: printable ones of Latin-1
    stand for themselves, the others for U+0100 and on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Pair:
    """Both tokenizers, with the bytes of each token."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode("utf-8"))
        self.a.encode_special_tokens = True
        alphabet, vocabulary = _byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode("utf-8")
        self.b = SentencePieceProcessor(model_proto=b_file)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode("utf-8"))
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # A token of B that goes on behind a space would make cutting at spaces wrong.
        self.cuts = not any(b" " in x.lstrip(b" ") for x in self.b_bytes)
        comma, bar, semicolon = ([f"{i}{c}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))] for c in ",|;")
        self.written = comma + bar + semicolon
        self.width = len(comma)
        self.forget()

    def _learn(self, words: list[str]) -> None:
        """Encode `words` with both tokenizers and put them into the table."""
        a_ids, a_sizes, b_ids, b_sizes = [], [], [], []
        at = 0
        while at < len(words):
            some, size = [], 0
            while at + len(some) < len(words) and (not some or size < ENCODED):
                some.append(words[at + len(some)])
                size += len(some[-1])
            spaced = [f" {w}" for w in some]
            encoded = self.a.encode_batch_fast(spaced, add_special_tokens=False)
            for word, e, y in zip(spaced, encoded, self.b.encode(some, num_threads=1), strict=True):
                x, whole = e.ids, word.encode("utf-8")
                a_ids += x
                b_ids += y
                a_sizes.append(len(x))
                b_sizes.append(len(y))
                alike = b"".join([self.a_bytes[t] for t in x]) == whole == b"".join([self.b_bytes[t] for t in y])
                self.alike.append(alike)
            at += len(some)
        for word in words:
            self.words[word] = len(self.words)
        for table, ids, sizes in ((self.a_table, a_ids, a_sizes), (self.b_table, b_ids, b_sizes)):
            table.add(ids, sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, Tokens, Tokens]:
        """Which texts both tokenizers give back byte by byte, and the tokens of these: A's of
        space + text, B's of text. Every word is encoded once while the table holds it."""
        if len(self.words) > WORDS or self.chars > WORD_CHARS:
            self.forget()
        parts = [_CUT.split(t) if self.cuts else [t] for t in texts]
        new = dict.fromkeys([w for own in parts for w in own if w not in self.words])
        self.chars += sum(map(len, new))
        self._learn(list(new))
        known, alike = self.words, np.array(self.alike, bool)
        used = [np.array([known[w] for w in own], np.int64) for own in parts]
        given_back = np.array([bool(alike[u].all()) or self._whole(t, u) for t, u in zip(texts, used, strict=True)], bool)
        kept = [u for u, good in zip(used, given_back, strict=True) if good]
        return given_back, self.a_table.tokens(kept, self.a_sizes), self.b_table.tokens(kept, self.b_sizes)

    def _whole(self, text: str, used: np.ndarray) -> bool:
        whole = b" " + text.encode("utf-8")
        sides = ((self.a_table, self.a_sizes, self.a_bytes), (self.b_table, self.b_sizes, self.b_bytes))
        return all(b"".join([names[t] for t in table.tokens([used], sizes).ids.tolist()]) == whole for table, sizes, names in sides)

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.chars, self.alike = 0, []
        self.a_table, self.b_table = _Words(), _Words()


class _Words:
    """The tokens of numbered words, behind one another."""

    def __init__(self):
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, ids: list[int], sizes: list[int]) -> None:
        self.ids = np.concatenate([self.ids, np.array(ids, np.int32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes, dtype=np.int64)])

    def tokens(self, texts: list[np.ndarray], sizes: np.ndarray) -> Tokens:
        """The tokens of texts that are given as numbers of words."""
        words = np.concatenate([np.zeros(0, np.int64), *texts])
        first, count = self.starts[words], np.diff(self.starts)[words]
        before = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        ids = self.ids[np.arange(before[-1]) + np.repeat(first - before[:-1], count)]
        starts = before[np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)]
        return Tokens(ids, sizes[ids], starts)


def _pair(a_file: bytes, b_file: bytes) -> _Pair:
    """The tokenizers, read once by each Python worker."""
    key = hashlib.md5(a_file + b_file).hexdigest()
    if key not in _known:
        _known[key] = _Pair(a_file, b_file)
    return _known[key]


# --- lockstep merging ----------------------------------------------------------------------


def lockstep(a: Tokens, b: Tokens, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links and cuts of the tokens of several texts, each of which covers the same bytes,
    at least one, in `a` and `b`: positions of linked A and B tokens, in order, and whether
    both end there. No token may be empty."""
    a_ends, b_ends = np.cumsum(a.sizes), np.cumsum(b.sizes)
    lanes = [np.arange(s, e, stretch) for s, e in zip(a.starts[:-1], a.starts[1:], strict=True)]
    first = np.concatenate(lanes) if lanes else np.zeros(0, np.int64)
    i, stop = first.copy(), np.append(first[1:], len(a.ids))
    j = np.searchsorted(b_ends, a_ends[i] - a.sizes[i], side="right")
    # Each step advances i, j or both, so i + j numbers the states of all lanes in order.
    linked = np.full(len(a.ids) + len(b.ids), -1, np.int64)
    cut = np.zeros(len(linked), bool)
    while len(i):
        a_end, b_end = a_ends[i], b_ends[j]
        state = i + j
        linked[state] = i
        cut[state] = a_end == b_end
        i = i + (a_end <= b_end)
        j = j + (b_end <= a_end)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    states = np.flatnonzero(linked >= 0)
    at_a = linked[states]
    return at_a, states - at_a, cut[states]


def _written(a: Tokens, b: Tokens, cut_a: np.ndarray, cut_b: np.ndarray, pair: _Pair) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` for each text, from the last tokens of all groups."""
    a_at, b_at = np.arange(len(a.ids)), np.arange(len(b.ids))
    a_group, b_group = np.searchsorted(cut_a, a_at), np.searchsorted(cut_b, b_at)
    b_before = np.concatenate([[0], cut_b + 1])
    codes = np.empty(len(a.ids) + len(b.ids), np.int64)
    codes[a_at + b_before[a_group]] = a.ids + pair.width * (cut_a[a_group] == a_at)
    codes[b_at + cut_a[b_group] + 1] = b.ids + 2 * pair.width * (cut_b[b_group] == b_at)
    names, ends = pair.written, (a.starts + b.starts).tolist()
    return ["".join([names[c] for c in codes[s:e].tolist()])[:-1] for s, e in zip(ends, ends[1:], strict=False)]


def _offsets(of: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)


def _aligned(texts: list[str | None], pair: _Pair) -> list[pa.Array]:
    """Columns n_a, n_b, n_groups, n_links, groups, pairs for some texts."""
    given = [k for k, t in enumerate(texts) if t]
    given_back, a, b = pair.encode([texts[k] for k in given])
    kept = [k for k, good in zip(given, given_back, strict=True) if good]
    at_a, at_b, cut = lockstep(a, b)
    n, rows = len(texts), np.array(kept, np.int64)
    # One number for text and id pair: sorting it sorts by text, then A id, then B id.
    wide = (len(pair.a_bytes), len(pair.b_bytes))
    text_of = np.repeat(rows, np.diff(a.starts))
    coded = (text_of[at_a] * wide[0] + a.ids[at_a]) * wide[1] + b.ids[at_b]
    distinct, times = np.unique(coded, return_counts=True)
    left, b_of = np.divmod(distinct, wide[1])
    of, a_of = np.divmod(left, wide[0])
    fields = [("a", a_of), ("b", b_of), ("n", times)]
    pairs = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for _, v in fields], [f for f, _ in fields])
    groups = [""] * n
    for k, text in zip(kept, _written(a, b, at_a[cut], at_b[cut], pair), strict=True):
        groups[k] = text

    def spread(values: np.ndarray) -> pa.Array:
        out = np.zeros(n, np.int64)
        out[rows] = values
        return pa.array(out)

    per_text = np.zeros(n, np.int64)
    np.add.at(per_text, text_of[at_a[cut]], 1)
    links = np.bincount(text_of[at_a], minlength=n).astype(np.int64)
    return [
        spread(np.diff(a.starts)), spread(np.diff(b.starts)), pa.array(per_text), pa.array(links),
        pa.array(groups, pa.string()), pa.ListArray.from_arrays(_offsets(of, n), pairs),
    ]


# --- operator ------------------------------------------------------------------------------


def align(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups and pairs.

    `a_path` is a byte-level BPE file, which encodes a space and the text, `b_path` a
    SentencePiece model, which puts the space there itself. `groups` lists the ids between
    the bytes where tokens of both end, as `a1,a2|b1;a3|b2,b3`; `pairs` has (a, b, n) for
    every pair of ids, n being the links that hold it, one for each two overlapping tokens.

    Null and empty texts, and texts that either tokenizer does not give back byte by byte
    (such as one with U+2581), have no tokens: counts are 0, `groups` is '' and `pairs` empty. A null
    doc_id is kept, repeated rows are repeated. No documents give no rows; other columns
    are not read. Both files are read on the driver.
    """
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append(f.read())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups string, "
        "pairs array<struct<a: int, b: int, n: int>>"
    )
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*files)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at = 0
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and (not some or size < MERGED):
                    some.append(texts[at + len(some)].as_py())
                    size += len(some[-1] or "")
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(some)), *_aligned(some, pair)], names)
                at += len(some)

    return docs.select("doc_id", "text").mapInArrow(merged, schema)


def _frequent_from(counts: DataFrame, most: int) -> int:
    """The least count so that at most `most` pairs have it or more, from a histogram with
    some hundred classes."""
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    classes = sorted(((r["step"], r["least"], r["rows"]) for r in counts.groupBy(step).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("rows")).collect()), reverse=True)
    total, least = 0, None
    for _, low, rows in classes:
        total += rows
        if total > most:
            break
        least = low
    return least if least is not None else (classes[0][1] * 2 if classes else 1)


def alignment(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECES, frequent: int = FREQUENT) -> DataFrame:
    """`align` with what the corpus says about its links, one row per document: doc_id, n_a,
    n_b, n_groups, n_links, n_best (links whose id pair is the most frequent one of its B
    id, ties included), count_sum (how often the pair of each link is linked in the
    corpus, added up), groups_sha256 ('' without tokens).

    For nulls, empty texts and repeated rows see `align`; repeated rows count each time.
    `frequent` bounds the table of counts that every task holds, not the result.
    """
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = saved(
        align(docs, a_path, b_path).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links",
            digest.alias("groups_sha256"), "pairs",
        )
    )
    linked = rows.select("row", F.inline("pairs"))
    counts = saved(linked.groupBy("a", "b").agg(F.sum("n").alias("n")))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    code = (F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("code")
    known = saved(counts.join(top, "b").select(code, F.col("n").alias("count"), (F.col("n") == F.col("top")).alias("best")))
    least = _frequent_from(counts, frequent)
    coded = linked.select("row", code, "n")
    often, seldom = known.where(F.col("count") >= least), known.where(F.col("count") < least)

    def added(found: DataFrame) -> DataFrame:
        return found.groupBy("row").agg(
            F.sum(F.col("n") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best")
        )

    # The broadcast has at most `frequent` rows, by the choice of `least`.
    sums = added(coded.join(F.broadcast(often), "code"))
    if not seldom.isEmpty():
        others = coded.join(F.broadcast(often.select("code")), "code", "left_anti")
        sums = sums.unionByName(added(others.join(seldom, "code")))
    sums = sums.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )
