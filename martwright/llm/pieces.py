"""SentencePiece encoding and decoding over a relational lattice.

Words that the corpus uses often are encoded once, in bulk: all substrings up to the
longest piece's length are exploded, an equi-join with the table of pieces leaves the
lattice's edges, edges are grouped by word, and an `aggregate` over the word's positions
folds them into its pieces. For a unigram model that is the Viterbi fold: the best path to
each position. A BPE model's scores are merge ranks, for which the best path is another
segmentation than the model's; there the fold replays the merges on the same edges: of all
edges that span two neighbouring parts the one with the highest score, the leftmost of
equals, joins them.

The frequent words with their pieces are a table of bounded size that every task holds.
Documents are then encoded where they lie: no token is shuffled. Words outside the table,
mostly seen once, are encoded in the task by the same rule.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, compress, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm.shared import saved

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 100_000  # words that a worker remembers beside the frequent ones
REMEMBERED = 256  # characters; a longer word is encoded each time
PART = 1 << 20  # characters of a batch whose ids are held at a time
COUNTED = 3000  # texts whose words are counted before the counts leave a task
SHORT = 48  # characters of a word that is merged together with others
TOGETHER = 4096  # words merged at a time
JOINED = 1 << 16  # ids whose strings are joined at a time
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Tasks that build and fold the lattice of the frequent words, at most 200,000 of them.
WORD_PARTS = 64


@dataclass
class Model:
    """Pieces with id and score, ids of the byte pieces and of the unknown piece."""

    bpe: bool
    pieces: dict[str, tuple[int, float]]
    names: list[str]
    byte_ids: list[int]
    unknown: int
    prefix: bool
    longest: int = field(init=False)
    cuts: re.Pattern = field(init=False)
    alone: re.Pattern = field(init=False)

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)
        self.cuts, self.alone = _cuts(self.pieces)

    @property
    def floor(self) -> float:
        """The score of a character without a piece: below all pieces."""
        return min((s for _, s in self.pieces.values()), default=0.0) - 10

    def single(self, char: str) -> list[int]:
        """A character that is no piece, as bytes or the unknown piece."""
        return [self.byte_ids[b] for b in char.encode("utf-8")] if self.byte_ids else [self.unknown]


def load(path: str = MODEL) -> Model:
    """A model file, read on the driver. Normalisation other than the identity is an error."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("a model with identity normalisation is needed")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    byte_ids = [i for i in ids if sp.is_byte(i)]
    return Model(spec.trainer_spec.model_type == 2, plain, [sp.id_to_piece(i) for i in ids], byte_ids, sp.unk_id(), spec.normalizer_spec.add_dummy_prefix)


def _cuts(pieces: dict[str, tuple[int, float]]) -> tuple[re.Pattern, re.Pattern]:
    """Matches the parts of a word: line ends and tabs stand alone, unless some piece holds
    one beside another character. No merge and no piece can cross such a cut. And matches
    what stands alone: a word without it is one part."""
    alone = re.escape("".join(c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in pieces)))
    return re.compile(f"[{alone}]|[^{alone}]+" if alone else "(?s:.+)"), re.compile(f"[{alone}]" if alone else "(?!)")


def words_of(text: str | None, prefix: bool) -> list[str]:
    """A text as words: a run of spaces, written as U+2581, and what follows it. Joined
    they are the text; no piece has U+2581 after another character."""
    if not text:
        return []
    return _WORDS.findall((SPACE if prefix else "") + text.replace(" ", SPACE))


def _key(word: str) -> str:
    """A word without its first U+2581, or after a space if it has none there; such keys are
    what `split` leaves of most texts, and no word holds a space."""
    return word[1:] if word[:1] == SPACE else " " + word


def _word(key: str) -> str:
    return key[1:] if key[:1] == " " else SPACE + key


def keys_of(text: str | None, prefix: bool) -> list[str]:
    """Keys of the words of a text."""
    if not text:
        return []
    if text[0] == " " or "  " in text or SPACE in text:
        return list(map(_key, words_of(text, prefix)))
    keys = text.split(" ")
    if not prefix:
        keys[0] = " " + keys[0]
    return keys


def encode_word(model: Model, word: str) -> list[int]:
    """Ids of one word of any length, by merges (BPE) or by the best path (unigram)."""
    return _merged(model, word) if model.bpe else _best_path(model, word)


def _merged(model: Model, word: str) -> list[int]:
    return _merged_short(model, word) if len(word) <= 64 else _merged_long(model, word)


def _merged_short(model: Model, word: str) -> list[int]:
    """Merges by looking at all neighbours each time: quickest for a few characters."""
    none, pieces = (-1, -np.inf), model.pieces
    parts = list(word)
    scores = [pieces.get(a + b, none)[1] for a, b in zip(parts, parts[1:], strict=False)]
    while scores:
        best = max(scores)
        if best == -np.inf:
            break
        i = scores.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i:
            scores[i - 1] = pieces.get(parts[i - 1] + parts[i], none)[1]
        if i < len(scores):
            scores[i] = pieces.get(parts[i] + parts[i + 1], none)[1]
    out: list[int] = []
    for p in parts:
        found = pieces.get(p)
        out += (found[0],) if found else model.single(p)
    return out


def _merged_long(model: Model, word: str) -> list[int]:
    """Merges in the order of a heap, for a word of any length."""
    pieces, n = model.pieces, len(word)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))  # start of the part before
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        found = pieces.get(word[a : end[b]])
        if found:
            heapq.heappush(heap, (-found[1], a, b, end[b]))

    for a in range(n - 1):
        offer(a, a + 1)
    gone = bytearray(n + 1)
    while heap:
        _, a, b, stop = heapq.heappop(heap)
        if gone[a] or gone[b] or end[a] != b or end[b] != stop:
            continue
        end[a] = stop
        gone[b] = 1
        if stop < n:
            before[stop] = a
            offer(a, stop)
        if before[a] >= 0:
            offer(before[a], a)
    out, at = [], 0
    while at < n:
        found = pieces.get(word[at : end[at]])
        out += [found[0]] if found else model.single(word[at : end[at]])
        at = end[at]
    return out


class Merges:
    """The same merges for many short words at once, a row of parts for each.

    Parts are numbered: pieces, then characters that only occur inside pieces. `keys` holds
    the pairs of parts that make a piece, `made` that piece and `order` its place by score,
    equal for equal scores.
    """

    def __init__(self, model: Model):
        names = list(model.pieces)
        number = {p: k for k, p in enumerate(names)}
        for c in sorted({c for p in names for c in p}):
            number.setdefault(c, len(number))
        self.model, self.size, self.none = model, len(number), np.iinfo(np.int32).max
        self.part = np.full(0x110000, -1, np.int32)
        for p, k in number.items():
            if len(p) == 1:
                self.part[ord(p)] = k
        # Parts other than pieces have no id here; words that end with one are left to others.
        self.ids = np.full(self.size + 1, -1, "<i4")
        self.ids[: len(names)] = [model.pieces[p][0] for p in names]
        self.lengths = np.zeros(self.size + 1, np.int32)  # characters of the pieces
        self.lengths[: len(names)] = [len(p) for p in names]
        place = {score: k for k, score in enumerate(sorted({s for _, s in model.pieces.values()}, reverse=True))}
        pairs = [
            (number[p[:i]] * self.size + number[p[i:]], number[p], place[model.pieces[p][1]])
            for p in names
            for i in range(1, len(p))
            if p[:i] in number and p[i:] in number
        ]
        keys, made, order = np.array(sorted(pairs), np.int64).reshape(-1, 3).T
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.made, self.order = np.append(made, 0).astype(np.int32), np.append(order, self.none).astype(np.int32)

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, piece) of pairs; no order where they make none."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        fits = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(fits, self.order[at], self.none), self.made[at]

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of at most SHORT characters that are pieces throughout in the end."""
        out: dict[str, bytes] = {}
        words = sorted(words, key=len)
        for at in range(0, len(words), TOGETHER):
            self._together(words[at : at + TOGETHER], out)
        return out

    def _together(self, words: list[str], out: dict[str, bytes]) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        parts = np.full((len(words), int(sizes.max()) + 1), -1, np.int32)  # a part too many: -1 at the end
        parts[np.arange(parts.shape[1]) < sizes[:, None]] = self.part[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        order, made = self._found(parts[:, :-1], parts[:, 1:])
        which, column = np.arange(len(words)), np.arange(parts.shape[1])
        while len(which):
            best = order.argmin(axis=1)  # the leftmost of equals
            row = np.arange(len(which))
            more = order[row, best] < self.none
            if not more.all():
                self._finished(parts[~more], which[~more], words, out)
                which, best, parts, order, made = which[more], best[more], parts[more], order[more], made[more]
                row = np.arange(len(which))
                if not len(which):
                    break
            parts[row, best] = made[row, best]
            after = column[None, :] > best[:, None]
            parts[:, :-1] = np.where(after[:, :-1], parts[:, 1:], parts[:, :-1])
            order[:, :-1] = np.where(after[:, :-2], order[:, 1:], order[:, :-1])
            made[:, :-1] = np.where(after[:, :-2], made[:, 1:], made[:, :-1])
            parts[:, -1], order[:, -1] = -1, self.none
            order[row, best], made[row, best] = self._found(parts[row, best], parts[row, best + 1])
            inner = np.flatnonzero(best)
            left = best[inner] - 1
            order[inner, left], made[inner, left] = self._found(parts[inner, left], parts[inner, left + 1])

    def _finished(self, parts: np.ndarray, which: np.ndarray, words: list[str], out: dict[str, bytes]) -> None:
        # A character without a part is -1 too, among the ids or behind them: counted by length.
        lengths = self.lengths[parts].sum(axis=1)
        own = list(map(words.__getitem__, which.tolist()))
        whole = lengths == np.fromiter(map(len, own), np.int64, len(own))
        ids = self.ids[parts[whole]]
        real = ids >= 0
        ends = 4 * np.cumsum(real.sum(axis=1))
        raw, at = ids[real].tobytes(), 0
        for word, end in zip(compress(own, whole.tolist()), ends.tolist(), strict=True):
            out[word] = raw[at:end]
            at = end


def _best_path(model: Model, word: str) -> list[int]:
    floor = model.floor
    best: list[tuple[float, int]] = [(0.0, 0)]  # (score, where the last piece starts)
    for e in range(1, len(word) + 1):
        options = [(best[s][0] + model.pieces[word[s:e]][1], s) for s in range(max(0, e - model.longest), e) if word[s:e] in model.pieces]
        if word[e - 1] not in model.pieces:
            options.append((best[e - 1][0] + floor, e - 1))
        best.append(max(options))
    out, at = [], len(word)
    while at:
        piece = word[best[at][1] : at]
        out.append([model.pieces[piece][0]] if piece in model.pieces else model.single(piece))
        at = best[at][1]
    return [i for ids in reversed(out) for i in ids]


# --- frequent words, relationally ---------------------------------------------------------


def word_counts(docs: DataFrame, model: Model) -> DataFrame:
    """(word, n) over all texts, counted in each batch first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), COUNTED):
                seen: Counter = Counter()
                for text in batch["text"].iloc[at : at + COUNTED]:
                    seen.update(keys_of(text, model.prefix))
                for key in [k for k in seen if model.alone.search(k)]:
                    n = seen.pop(key)
                    for part in model.cuts.findall(_word(key)):
                        seen[_key(part)] += n
                yield pd.DataFrame({"word": list(map(_word, seen)), "n": list(seen.values())})

    return docs.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame([(p, i, s) for p, (i, s) in model.pieces.items()], "piece string, id int, score double")


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, edges): every substring of up to `longest` characters that is a piece, as
    (s, e, score, id), by where it starts and ends. Words without an edge are left out."""
    # Words are dealt once, and what is made of a word stays where it is; the table of
    # pieces is as large as the vocabulary and no more. The number is given, since words
    # are small and folding them is not: by size alone they would all go to one task.
    starts = words.where("word <> ''").repartition(WORD_PARTS, "word").select("word", F.explode(F.expr("sequence(1, char_length(word))")).alias("i"))
    ends = starts.select("word", "i", F.explode(F.expr(f"sequence(1, least({longest}, char_length(word) - i + 1))")).alias("l"))
    substrings = ends.select("word", "i", "l", F.expr("substr(word, i, l)").alias("piece"))
    edge = F.struct((F.col("i") - 1).alias("s"), (F.col("i") - 1 + F.col("l")).alias("e"), "score", "id")
    return substrings.join(F.broadcast(pieces), "piece").groupBy("word").agg(F.collect_list(edge).alias("edges"))


def fold_viterbi(floor: float) -> Column:
    """The best path over `edges` of `word`: its parts as (s, e, id), id null where a
    character is no piece. The state holds the best (score, parts) for each position."""
    return F.expr(
        f"""aggregate(sequence(1, char_length(word)),
              array(named_struct('score', double(0), 'parts', array_remove(array(named_struct('s', 0, 'e', 0, 'id', 0)), named_struct('s', 0, 'e', 0, 'id', 0)))),
              (state, at) -> array_append(state, array_max(concat(
                transform(filter(edges, x -> x.e = at), x -> named_struct(
                  'score', state[x.s].score + x.score,
                  'parts', array_append(state[x.s].parts, named_struct('s', x.s, 'e', x.e, 'id', x.id)))),
                CASE WHEN exists(edges, x -> x.e = at AND x.s = at - 1) THEN filter(state, y -> false)
                     ELSE array(named_struct(
                  'score', state[at - 1].score + double({floor!r}),
                  'parts', array_append(state[at - 1].parts, named_struct('s', at - 1, 'e', at, 'id', int(null))))) END))),
              state -> element_at(state, -1).parts)"""
    )


def fold_merges() -> Column:
    """The parts that merging leaves: the state holds where parts begin and end, and a
    step removes the end inside the best edge that spans two neighbouring parts."""
    return F.expr(
        """aggregate(sequence(2, greatest(2, char_length(word))), sequence(0, char_length(word)),
             (ends, step) -> array_except(ends, array(coalesce(
               array_max(transform(
                 filter(edges, x -> array_position(ends, x.s) > 0 AND array_position(ends, x.e) = array_position(ends, x.s) + 2),
                 x -> named_struct('score', x.score, 'left', -x.s,
                                   'inside', element_at(ends, int(array_position(ends, x.s) + 1))))).inside, -1))))"""
    )


def frequent(docs: DataFrame, model: Model, most: int = 200_000, longest_word: int = 48) -> dict[str, bytes]:
    """Ids of the words seen most often, at most `most` of up to `longest_word` characters:
    all those with at least the smallest count for which there are no more."""
    counts = saved(word_counts(docs, model).where(F.char_length("word") <= longest_word))
    total, least = 0, None
    steps = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("words"))
    for r in sorted(steps.collect(), key=lambda r: -r["n"]):  # at most 100,000 rows
        if total + r["words"] > most:
            break
        total, least = total + r["words"], r["n"]
    if least is None:
        return {}
    words = counts.where(F.col("n") >= least).select("word")
    edges = lattice(words, piece_table(docs.sparkSession, model), model.longest)
    if model.bpe:
        ends = fold_merges()
    else:
        ends = F.concat(F.array(F.lit(0)), F.transform(fold_viterbi(model.floor), lambda p: p["e"]))
    out = {}
    for r in edges.select("word", ends.alias("ends")).toLocalIterator():  # at most `most` rows
        out[r["word"]] = _as_bytes(model, [r["word"][a:b] for a, b in zip(r["ends"], r["ends"][1:], strict=False)])
    return out


def _as_bytes(model: Model, parts: list[str]) -> bytes:
    ids: list[int] = []
    for p in parts:
        found = model.pieces.get(p)
        ids += [found[0]] if found else model.single(p)
    return np.array(ids, "<i4").tobytes()


# --- documents ----------------------------------------------------------------------------


class _Words(dict):
    """Ids of words as bytes, by their keys: the frequent ones, and up to CACHE of those met
    meanwhile.

    It is what is broadcast, so a Python worker holds one, whatever number of tasks it runs,
    and remembers words from one task to the next.
    """

    def __init__(self, model: Model, known: dict[str, bytes]):
        super().__init__((_key(word), ids) for word, ids in known.items())
        self.model, self.most, self.merges = model, len(known) + CACHE, None
        self.passing: dict[str, bytes] = {}  # words of the texts at hand that are not remembered

    def __missing__(self, key: str) -> bytes:
        if (ids := self.passing.get(key)) is not None:
            return ids
        word = _word(key)
        parts = self.model.cuts.findall(word)
        if len(parts) > 1:
            ids = b"".join(self.get(_key(p)) or np.array(encode_word(self.model, p), "<i4").tobytes() for p in parts)
        else:
            ids = np.array(encode_word(self.model, word), "<i4").tobytes()
        if len(self) < self.most and len(word) <= REMEMBERED:
            self[key] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        return self._ids(keys_of(text, self.model.prefix))

    def _ids(self, keys: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, keys)), "<i4")

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; the words that none of them had before are merged together."""
        texts = [keys_of(t, self.model.prefix) for t in texts]
        if not self.model.bpe:
            yield from map(self._ids, texts)
            return
        if self.merges is None:
            self.merges = Merges(self.model)
        new = set().union(*texts).difference(self)
        cut = {k: list(map(_key, self.model.cuts.findall(_word(k)))) for k in new if self.model.alone.search(k)}
        new.difference_update(cut)
        new.update(p for parts in cut.values() for p in parts if p not in self)
        short = {_word(k): k for k in new if len(k) < SHORT}
        self.passing = {short[word]: ids for word, ids in self.merges.encode(list(short)).items()}
        self.passing |= {k: b"".join(map(self.__getitem__, parts)) for k, parts in cut.items() if len(k) < REMEMBERED}
        self.update(islice(self.passing.items(), max(0, self.most - len(self))))
        yield from map(self._ids, texts)


def _parts(batch, texts: pd.Series) -> Iterator:
    """A batch in parts of PART characters or one text, so that what is made of it is never
    held for all its rows at once."""
    size = texts.str.len().fillna(0).cumsum().to_numpy()
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART, "right")))
        yield batch.iloc[at:stop]
        at = stop


def encode(docs: DataFrame, model: Model, known: dict[str, bytes] | None = None) -> DataFrame:
    """`docs` with `ids`, the array of piece ids of the whole text.

    Null and empty texts have no ids. A text's own U+2581 is encoded as a space. Other
    columns and repeated rows stay; a column named ids is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(_Words(model, frequent(docs, model) if known is None else known))

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = held.value
        for batch in batches:
            for texts in _parts(batch, batch):
                yield pd.Series(list(words.encode_all(texts)))

    return docs.withColumn("ids", ids("text"))


class Strings:
    """Byte strings by number, joined for many numbers at once."""

    def __init__(self, strings: list[bytes]):
        self.length = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        if len(ids) > JOINED:
            return b"".join(self.joined(ids[at : at + JOINED]) for at in range(0, len(ids), JOINED))
        n = self.length[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.start[ids] - (ends - n), n)
        return self.flat[at + np.arange(len(at))].tobytes()


def decode_ids(model: Model, ids: np.ndarray) -> str:
    """The text of ids: pieces in order, byte pieces as bytes, without the leading space
    that encoding puts in front. Control pieces give nothing, unknown ones U+2047 in spaces."""
    text = _bytes_of(model).joined(np.asarray(ids, np.int64)).decode("utf-8", "replace")
    return text[1:] if model.prefix and text.startswith(" ") else text


_tables: dict[int, Strings] = {}


def _bytes_of(model: Model) -> Strings:
    if id(model) not in _tables:
        out = [b""] * len(model.names)
        for piece, (i, _) in model.pieces.items():
            out[i] = piece.replace(SPACE, " ").encode("utf-8")
        for b, i in enumerate(model.byte_ids):
            out[i] = bytes([b])
        if model.unknown >= 0:
            out[model.unknown] = " ⁇ ".encode()
        _tables.clear()
        _tables[id(model)] = Strings(out)
    return _tables[id(model)]


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """`encoded` with `decoded`, the text of `ids`; null for null."""
    held = encoded.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if i is None else decode_ids(held.value, i) for i in batch], dtype="object")

    return encoded.withColumn("decoded", text("ids"))


SUMMARY = "doc_id long, n_tokens long, ids_sha256 string, n_byte_pieces long, round_trip boolean"


def summary(docs: DataFrame, model: Model, known: dict[str, bytes] | None = None) -> DataFrame:
    """Documents encoded and decoded again: doc_id, n_tokens, ids_sha256 (of the ids,
    comma-joined), n_byte_pieces and round_trip, whether decoding gives the text. Nulls
    and empty texts as in `encode`; a null text counts as empty."""
    held = docs.sparkSession.sparkContext.broadcast(_Words(model, frequent(docs, model) if known is None else known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, own = held.value, held.value.model
        listed = Strings([b"%d," % i for i in range(len(own.names))])
        low, high = (own.byte_ids[0], own.byte_ids[-1]) if own.byte_ids else (-1, -2)
        for batch in batches:
            rows = []
            encoded = chain.from_iterable(words.encode_all(texts) for texts in _parts(batch["text"], batch["text"]))
            for (doc_id, text), ids in zip(batch.itertuples(index=False), encoded, strict=True):
                sha256 = hashlib.sha256(listed.joined(ids)[:-1]).hexdigest()
                same = decode_ids(own, ids) == (text or "").replace(SPACE, " ")
                n = int(((ids >= low) & (ids <= high)).sum())
                rows.append((None if pd.isna(doc_id) else int(doc_id), len(ids), sha256, n, same))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMARY.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select(docs["doc_id"].cast("long"), "text").mapInPandas(run, SUMMARY)
