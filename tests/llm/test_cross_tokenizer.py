"""Cross-tokenizer alignment against offsets compared one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from martwright.llm import cross_tokenizer as ct
from martwright.llm.queries import ship
from martwright.llm.shared import table

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "row a b n pairs groups count best top code n_a n_b n_best count_sum least step".split()


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def documents(spark, texts):
    df = spark.createDataFrame([(k if k else None, t, "en", "s", 0) for k, t in enumerate(texts)], DOC).repartition(3)
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])


def encoded():
    """Functions from a text to (id, bytes) by either library, without the module's tables."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(ct.BYTE_BPE), SentencePieceProcessor(model_file=ct.PIECES)
    a.encode_special_tokens = True
    own = decoders.ByteLevel()
    assert own.decode(["Ġx"]) == " x"
    letters = {}
    rest = 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            letters[chr(byte)] = byte
        else:
            letters[chr(256 + rest)] = byte
            rest += 1

    def by_a(text):
        e = a.encode(" " + text, add_special_tokens=False)
        return [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]

    def by_b(text):
        return [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]

    return by_a, by_b


def spans(tokens):
    at, out = 0, []
    for i, piece in tokens:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def brute(texts):
    by_a, by_b = encoded()
    per_text, counts = [], Counter()
    for text in texts:
        a, b = (by_a(text), by_b(text)) if text else ([], [])
        whole = b" " + (text or "").encode()
        if b"".join(p for _, p in a) != whole or b"".join(p for _, p in b) != whole:
            a, b = [], []
        a, b = spans(a), spans(b)
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        cuts = sorted({e for *_, e in a} & {f for *_, f in b})
        groups, low = [], 0
        for cut in cuts:
            inside = [",".join(str(i) for i, s, _ in side if low <= s < cut) for side in (a, b)]
            groups.append("|".join(inside))
            low = cut
        counts.update(links)
        per_text.append((len(a), len(b), links, groups))
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [
        (
            n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "",
        )
        for n_a, n_b, links, groups in per_text
    ]


ODD = [
    None, None, "", " ", "a", "  two  spaces ", "<|endoftext|> <s></s><unk> <0x41>", "not ▁ given back", "日本語 🎉 naïve", "x" * 700,
    "\n\n\ttabs\r\n", "same text here", "same text here", "it's 12345 don't", " 　", "é ‍", "\x00 \x01",
]


def columns(df):
    return df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("frequent", [0, 40, 1 << 18])
def test_alignment_by_brute_force(spark, frequent):
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice("abé -.\n日e t") for _ in range(rng.randrange(60))) for _ in range(60)]
    got = columns(ct.alignment(documents(spark, texts), frequent=frequent)).collect()
    want = [(k if k else None, *row) for k, row in enumerate(brute(texts))]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_documents_of_the_test_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text").collect()
    short = [r for r in rows if len(r.text or "") < 3000]
    few = spark.createDataFrame(short, "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in columns(ct.alignment(few)).collect()}
    want = brute([r.text for r in short])
    assert got == {r.doc_id: row for r, row in zip(short, want, strict=True)}


def test_outputs(spark):
    r = ct.align(documents(spark, ["", "hello world"])).where("n_a > 0").first()
    assert r.groups.count(";") == r.n_groups - 1 and sum(p.n for p in r.pairs) == r.n_links
    sides = [[side.split(",") for side in group.split("|")] for group in r.groups.split(";")]
    assert sum(len(a) for a, _ in sides) == r.n_a and sum(len(b) for _, b in sides) == r.n_b


def test_no_documents(spark):
    assert ct.alignment(documents(spark, ["x"]).limit(0)).collect() == []
    assert ct.alignment(documents(spark, [None, ""])).where("n_a + n_b + n_links + count_sum + n_best > 0").count() == 0


def test_lanes_do_not_change_links():
    """Any stretch gives the links of one lane for each text."""
    rng = np.random.default_rng(7)
    ends = [np.sort(rng.choice(np.arange(1, 5000), n, replace=False)) for n in (900, 1500)]
    a, b = (ct.Tokens(np.arange(len(e) + 2), np.diff(np.concatenate([[0], e, [5000, 5100]])), np.array([0, len(e) + 1, len(e) + 2])) for e in ends)
    want = [x.tolist() for x in ct.lockstep(a, b, 10**6)]
    for stretch in (1, 2, 7, 256):
        assert [x.tolist() for x in ct.lockstep(a, b, stretch)] == want


def test_words_encode_like_whole_texts(monkeypatch):
    """Cut at spaces, with a table that is dropped all the time, and as the libraries do it."""
    by_a, by_b = encoded()
    pair = ct._Pair(open(ct.BYTE_BPE, "rb").read(), open(ct.PIECES, "rb").read())
    assert pair.cuts
    monkeypatch.setattr(ct, "WORDS", 5)
    monkeypatch.setattr(ct, "ENCODED", 20)
    rng = random.Random(8)
    words = ["été", "don't", "a", "12", "x-y", "日本", " ", "", "\n", "end. ", "_", "é", "'s", "\x1c", "\u00a0", "(", "...", "▁"]
    texts = [" ".join(rng.choice(words[: 10 + 4 * (k % 3)]) for _ in range(300)) or "x" for k in range(30)] + ["x" * 5000, "no_space" * 500]
    for k in range(0, len(texts), 4):
        some = texts[k : k + 4]
        good, a, b = pair.encode(some)
        want = [(by_a(t), by_b(t)) for t in some]
        whole = [b" " + t.encode() for t in some]
        assert good.tolist() == [b"".join(x for _, x in u) == w == b"".join(x for _, x in v) for (u, v), w in zip(want, whole, strict=True)]
        kept = [w for w, g in zip(want, good, strict=True) if g]
        for tokens, side in ((a, 0), (b, 1)):
            assert tokens.ids.tolist() == [i for w in kept for i, _ in w[side]]
            assert tokens.sizes.tolist() == [len(x) for w in kept for _, x in w[side]]
            assert np.diff(tokens.starts).tolist() == [len(w[side]) for w in kept]
