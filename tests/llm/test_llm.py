"""The text operators against brute force, on small tables with nulls, ties and repeats."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter
from unittest.mock import MagicMock

import numpy as np
import pandas as pd
import pytest
import xxhash

from martwright.llm import (
    decontamination,
    language_id,
    license_scan,
    pieces,
    quality_classifier,
    sharding,
    simhash,
    suffix_dedup,
    topk,
    url_filters,
)
from martwright.llm.queries import queries, ship
from martwright.llm.shared import connected_components, few_of_each, table

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def documents(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


ODD = [None, "", "   ", "a", "a", "\n\n", "x" * 50_000, "é" * 3, "日本 語"]


def prose(rng, n, words=None):
    words = words or ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


# --- urls ---------------------------------------------------------------------------------


def test_hosts_paths_and_rules(spark):
    urls = {
        None: ("", "", None),
        "no scheme": ("", "", None),
        "http://A.Example.NET/en/1?x": ("a.example.net", "/en/1", "example.net/en/"),
        "http://example.net": ("example.net", "", None),
        "http://example.net/fr#a": ("example.net", "/fr", "net/"),
        "x://badexample.com/de/": ("badexample.com", "/de/", None),
        "x://b.example.com/de/1": ("b.example.com", "/de/1", "example.com/de/"),
        "x://org/fr/": ("org", "/fr/", "org/fr/"),
    }
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df.union(df)).collect()}
    for i, want in enumerate(urls.values()):
        assert got[i][:3] == want
    assert got[2][3] == "allow" and got[4][3] == got[6][3] == "block" and got[7][3] == "allow"
    assert url_filters.judge(df.limit(0)).count() == 0


def test_bad_templates_are_rejected(spark):
    pages = [(i, f"http://h.test/{'bad' if i % 2 else 'good'}/{i}.html") for i in range(60)]
    labels = [(i, i % 2) for i in range(40)]
    df, known = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")
    got = {r.page_id: r.verdict for r in url_filters.judge(df, known).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(60))


@pytest.mark.parametrize("directories", [32, 33, 60])
def test_verdicts_do_not_depend_on_the_number_of_siblings(spark, directories):
    """One bad directory among others that are unlabelled, or good; pages that vary share labels."""
    urls = [f"http://a.example.com/{'de' if k == 0 else f'd{k}'}/{j}" for k in range(directories) for j in range(5)]
    got = url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert all(r.verdict == ("block" if "/de/" in r.path else "allow") for r in got)
    urls = [f"http://b.test/{'bad' if k == 0 else f'd{k}'}/{j}" for k in range(directories) for j in range(8)]
    urls += [f"http://c.test/{d}/{''.join(chr(97 + int(c)) for c in str(k))}" for d in ("bad", "good") for k in range(directories)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    known = spark.createDataFrame([(i, int("/bad/" in u)) for i, u in enumerate(urls) if i % 2], "page_id long, bad int")
    got = url_filters.judge(pages, known).collect()
    assert all(r.verdict == ("block" if "/bad/" in r.path else "allow") for r in got)


@pytest.mark.parametrize("shared", ["a/b/c/d/e", "/".join(f"s{k}" for k in range(40)), "x/" * 30 + "y"])
def test_deep_paths_are_judged_to_their_end(spark, shared):
    urls = [f"http://h.test/{shared}/{'bad' if i % 2 else 'good'}/{i}" for i in range(60)]
    known = spark.createDataFrame([(i, i % 2) for i in range(40)], "page_id long, bad int")
    rows = url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), known).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in rows)


def test_large_branches_are_told_apart_by_counts(spark):
    """Branches with hundreds of different children: those that lead to the same kinds in the same
    shares are one template, one that ends in other kinds is its own."""
    rng = random.Random(11)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    urls = [f"http://h.test/{d}/{name()}" for d in ("a", "b", "c") for _ in range(400)]
    urls += [f"http://h.test/d/{rng.randrange(10**6)}" for _ in range(400)]
    labels = [(i, int(i >= 1200)) for i in range(0, 1600, 7)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filters.judge(pages, spark.createDataFrame(labels, "page_id long, bad int")).collect()
    first = {r.path.split("/")[1]: r.template.split("/")[1] for r in rows}
    assert first["a"] == first["b"] == first["c"] == "*-" and first["d"] == "d"
    assert all(r.verdict == ("block" if r.path.startswith("/d/") else "allow") for r in rows)


def test_pages_without_labels_are_judged_by_their_path_elsewhere(spark):
    """Three domains agree that /spam/ is bad: an unlabelled fourth follows. One alone does not do."""
    urls = [f"http://w.{d}.test/{s}/{i}" for d in ("a", "b", "c") for s in ("spam", "news") for i in range(30)]
    urls += [f"http://only.test/{s}/{i}" for s in ("lone", "more") for i in range(30)]
    labels = [(i, int("/spam/" in u or "/lone/" in u)) for i, u in enumerate(urls)]
    new = [f"http://new.org/{s}/{i}" for s in ("spam", "news", "lone") for i in range(5)]
    pages = spark.createDataFrame(list(enumerate(urls + new)), "page_id long, url string")
    rows = url_filters.judge(pages, spark.createDataFrame(labels, "page_id long, bad int")).collect()
    got = {(r.path.split("/")[1], r.verdict) for r in rows if r.host == "new.org"}
    assert ("spam", "block") in got and ("news", "allow") in got and len(got) == 3


def test_hosts_paths_and_rules_by_brute_force(spark):
    rng = random.Random(12)
    parts = ["example", "net", "com", "org", ".", "/", "en", "de", "fr", "//", ":", "?", "#", "A.Example.NET", "http", "x"]
    urls = ["".join(rng.choice(["http://", "", "s://"]) + "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for _ in range(400)]
    got = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, url in enumerate(urls):
        after = url.split("://", 1)[1] if "://" in url else ""
        host = re.split("[/?#]", after)[0]
        path = re.split("[?#]", after[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = []
        for text, verdict in url_filters.RULES:
            name, _, start = text.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
                fits.append((len(text), text, verdict))
        rule = max(fits)[1:] if fits else (None, got[i].verdict)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *rule)


# --- learned ------------------------------------------------------------------------------


def test_factorisation_machine_in_linear_time():
    rng = np.random.default_rng(1)
    m = quality_classifier.Machine(8, 0.3, rng.normal(size=24), rng.normal(size=(24, 3)))
    i, x = np.array([1, 4, 9]), np.array([0.5, -2.0, 1.0])
    pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(3) for b in range(a + 1, 3))
    assert m.raw(i, x) == pytest.approx(0.3 + m.linear[i] @ x + pairs)


def test_quality_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = quality_classifier.classify(table(spark, d, "documents"), table(spark, d, "labels"))
    known = {r.doc_id: r.quality for r in table(spark, d, "labels").collect()}
    got = rows.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.predicted, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 0


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_classifier.classify(documents(spark, ODD), none).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_language_on_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language_id.identify(docs, language_id.train(docs)).where("held_out").collect()
    assert sum(r.lang_pred == want[r.doc_id] for r in got) >= 0.97 * len(got) > 0
    odd = documents(spark, [None, "", "12 34 !", "a"], lang=None)
    assert language_id.train(odd) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}


def test_a_repeated_id_gives_few_training_rows(spark):
    """One doc_id on most rows, copies and different texts: the driver gets a bounded number."""
    frame = spark.range(3000, numPartitions=6).selectExpr(
        "if(id < 2900, 1, id) AS doc_id", "if(id < 1000, 'same', 'text ' || id) AS text", "id AS other"
    )
    got = Counter(r.doc_id for r in few_of_each(frame, 4).collect())
    assert got[1] == 4 and len(got) == 101 and set(got.values()) == {1, 4}
    docs = frame.selectExpr("doc_id", "text", "'en' AS lang", "length(text) AS n_chars")
    labels = spark.createDataFrame([(1, 1), (2950, 0)], "doc_id long, quality int")
    assert quality_classifier.classify(docs, labels).count() == 3000
    assert list(language_id.train(docs).languages) == ["en"]


# --- near-duplicates and repeats -----------------------------------------------------------


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 300)] + [(5, i) for i in range(400, 450)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 301)}, **{i: 5 for i in [5, *range(400, 450)]}}


@pytest.mark.parametrize("dense", [200, 1])
def test_links_connect_all_within_two_bits(spark, dense):
    rng = random.Random(dense)
    fps = {0}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 5)):
            fps.add(base)
            for _ in range(rng.randint(1, 3)):
                base ^= 1 << rng.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    chosen = [(list(range(32)), 1), (list(range(32, 64)), 0)] if dense == 1 else None
    got = connected_components(simhash.links(df, dense=dense, chosen=chosen))
    comp = {r.node: r.component for r in got.collect()}
    x = np.array(signed).view(np.uint64)
    close = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    label = np.array(signed)
    while True:
        new = np.where(close, label[None, :], np.iinfo(np.int64).max).min(1)
        if (new == label).all():
            break
        label = new
    assert {f: comp.get(f, f) for f in signed} == dict(zip(signed, label.tolist(), strict=True))


def test_fingerprints(spark):
    rows = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, ODD)).collect()}
    assert rows[0].fingerprint == rows[1].fingerprint == rows[2].fingerprint == "0" * 16
    assert rows[3].component_id == rows[4].component_id == 3 and rows[5].component_id == 0


def brute_fingerprint(text, width=3):
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    runs = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(texts):
    """The first text of each one's component, comparing all fingerprints."""
    fps = [brute_fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and (fps[i] ^ fps[j]).bit_count() <= 2:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return fps, group


def near_families(rng):
    """Copies in other case and spacing, texts with a word replaced, appended or cut."""
    texts = list(ODD)
    for _ in range(30):
        words = prose(rng, rng.choice([3, 40, 400, 1500])).split()
        texts.append(" ".join(words))
        for _ in range(rng.randrange(6)):
            own = list(words)
            own[rng.randrange(len(own))] = rng.choice(["other", "word", own[0]])
            texts.append(rng.choice([" ".join(own), "\n ".join(words).upper(), " ".join(words[:-1]), " ".join([*words, "more"])]))
    return texts


def test_near_duplicates_by_brute_force(spark):
    texts = near_families(random.Random(3))
    fps, group = brute_components(texts)
    assert 20 < len(set(group)) < len(set(fps))
    docs = documents(spark, texts)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", group[i]) for i in range(len(texts))}
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(set(group))


def brute_removal(texts, depth):
    seen = Counter(b[i : i + depth] for t in texts for b in [(t or "").encode()] for i in range(len(b) - depth + 1))
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        yield len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("gather", [4000, 1])
def test_repeats_by_brute_force(spark, monkeypatch, gather):
    monkeypatch.setattr(suffix_dedup, "GATHER", gather)
    rng = random.Random(4)
    part = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(5, 90))) for _ in range(6)]
    texts = [None, "", "a" * 300, "ab" * 200]
    for _ in range(80):
        texts.append("".join("".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 60))) + rng.choice(part)[rng.randint(0, 9) :] for _ in range(3)))
    texts += texts[4:8] + [texts[4]] * 3
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(documents(spark, texts), 20).collect()}
    assert [tuple(got[i])[1:5] for i in range(len(texts))] == list(brute_removal(texts, 20))
    for r in got.values():  # the text that is left; characters of which a byte is cut are not in it
        kept = len(r.text.encode())
        assert kept == r.n_bytes if r.n_removed == 0 else r.n_bytes - r.n_removed - 2 * r.n_spans <= kept <= r.n_bytes - r.n_removed


def test_repeats_hold_little_at_a_time(spark):
    """What a Python worker makes of many rows, of one batch or one group, is held and handed on in parts."""
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    scan = MagicMock()
    suffix_dedup._scan(scan, 400, 200, "bytes")
    run = scan.select.return_value.mapInPandas.call_args[0][0]
    batch = pd.DataFrame([(b"%d" % k, text[k:]) for k in range(1000)], columns=["uid", "text"])
    sizes = [len(frame) for frame in run(iter([batch]))]
    assert len(sizes) > 1 and max(sizes) < 70_000 and sum(sizes) > 150_000

    rows = MagicMock()
    rows.where.return_value.count.return_value = 0
    suffix_dedup._edges(rows, 400, "bytes")
    inside = rows.where.return_value.groupBy.return_value.applyInPandas.call_args[0][0]
    spread = rows.where.return_value.mapInPandas.call_args[0][0]
    group = pd.DataFrame([(b"%d" % k, k, 200, k % 50, 1 + k // 1999, 2, text[k : k + 599].encode()) for k in range(2000)])
    group.columns = [c.split()[0] for c in suffix_dedup.WINDOWS.split(", ")]
    tracemalloc.start()
    ranges = inside(group)
    peak = tracemalloc.get_traced_memory()[1]
    sizes = [len(frame) for frame in spread(iter([group]))]
    tracemalloc.stop()
    assert peak < 12e6  # 400,000 windows; 30 MB as Python numbers in a dict
    assert max(sizes) < 70_000 and len(sizes) < 10 and sum(sizes) == 400_000
    # A row shares windows with the next of its run, 50 further: all of them but the first and last row's outer 50.
    assert len(ranges) == 1999 and dict(zip(ranges["uid"], ranges["n"], strict=True))[b"777"] == 200
    got = {r.uid: (r.start, r.n) for r in ranges.itertuples()}
    assert got[b"3"] == (53, 150) and got[b"1998"] == (1998, 150) and b"1999" not in got


def test_repeated_words_are_cut(spark):
    rng = random.Random(5)
    shared = prose(rng, 55)
    docs = documents(spark, [prose(rng, 40) + f" begin{k} " + shared + f" end{k} " + prose(rng, 30) for k in range(3)] + ["alone", None])
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs, 50, "words").collect()}
    assert all(shared not in got[i] and f" begin{i} " in got[i] for i in range(3)) and got[3] == "alone" and got[4] is None


# --- search, tokens, licenses, leaks, shards -----------------------------------------------


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 12)).astype(np.float32)
    x[5] = x[6]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (1000, [1.0, None]), (1100, [float("nan")] * 12)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), tree=256).collect()]
    e = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 700, 100):
        s = e @ e[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:10]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(best)]
    assert sorted(got) == want


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model, sp = pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for t in ODD if t] + ["  Hello  world\n\tx ", "<0x0A> </s>", "don't (stop) 3.14 😀", prose(random.Random(7), 200)]
    docs = documents(spark, [*texts, None, ""])
    for known in (None, {}):
        rows = pieces.decode(pieces.encode(docs, model, known), model).collect()
        for r in rows:
            assert list(r.ids) == (sp.encode(r.text) if r.text else []) and r.decoded == (r.text or "")
    assert pieces._merged_long(model, "▁hellohello" * 20) == pieces._merged_short(model, "▁hellohello" * 20)


def test_pieces_of_a_batch_in_parts(spark):
    """Ids leave a worker in parts; rows and ids stay together, whatever the texts' length."""
    import sentencepiece

    model, sp = pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(21)
    texts = [prose(rng, n) for n in (5, 300_000, 1, 40, 90_000, 90_000, 3)] + ["x" * 300 + " y"] * 2 + [None, "", "a"]
    got = pieces.encode(documents(spark, texts).coalesce(1), model, {}).collect()
    assert len(got) == len(texts)
    assert all(list(r.ids) == (sp.encode(r.text) if r.text else []) for r in got)
    long = pd.Series(["ab", None, "c" * pieces.PART, "d", "e" * pieces.PART, ""])
    cut = [list(p.index) for p in pieces._parts(long, long)]
    assert sum(cut, []) == list(range(6)) and max(map(len, cut)) < 6
    assert list(pieces._parts(long.iloc[:0], long.iloc[:0])) == []


def test_viterbi_fold_finds_the_best_path(spark):
    rng = random.Random(8)
    table_ = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): (i, -rng.random() * 5) for i in range(40)}
    model = pieces.Model(False, table_, [], [], 0, True)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    frame = spark.createDataFrame([(w,) for w in set(words)], "word string")
    edges = pieces.lattice(frame, pieces.piece_table(spark, model), model.longest)
    for r in edges.select("word", pieces.fold_viterbi(model.floor).alias("parts")).collect():
        ids = [p["id"] if p["id"] is not None else model.unknown for p in r.parts]
        assert ids == pieces._best_path(model, r.word)


def test_licenses(spark):
    texts = ["Licensed under the Apache License, Version 2.0. All rights reserved. CC-BY cc by", "xcc by", None, "General public\nlicense"]
    rows = {r.doc_id: r for r in license_scan.scan(documents(spark, texts)).collect()}
    assert (rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].base_labels) == (3, 8, 13, "cc-by,reserved")
    assert "apache-2.0" in rows[0].labels.split(",") and len(license_scan.rules()) > 200
    assert (rows[1].n_base, rows[1].first_word, rows[1].labels, rows[1].score) == (0, None, "", 0.0)
    assert rows[2].n_words == 0 and rows[3].base_labels == "gpl"


LICENSED = {
    "SPDX-License-Identifier: GPL-2.0-only": "gpl-2-only",
    "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3-or-later",
    "SPDX-License-Identifier: AGPL-3.0-only": "agpl-3-only",
    "// SPDX-License-Identifier: MIT": "mit",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "see http://www.apache.org/licenses/LICENSE-2.0 for it": "apache-2.0",
    "https://opensource.org/licenses/MIT": "mit",
    "GNU General Public License v2": "gpl-2",
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
    "version 2.1 of the License, or (at your option) any later version.": "lgpl-2.1-or-later",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
    "later version.": "gpl-2-or-later",
    "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa-4.0",
    "Mozilla Public License, v. 2.0": "mpl-2.0",
    "Distributed under the Boost Software License, Version 1.0.": "boost-1.0",
    "Neither the name of the copyright holder nor the names of its contributors may be used": "bsd-3-clause",
}


@pytest.mark.parametrize("text", LICENSED)
def test_signatures(text):
    got = {r.label for _, _, r in license_scan.detections(license_scan.alnum_words(text), license_scan.index(license_scan.rules()))}
    assert got - {"gpl", "copyright"} == {LICENSED[text]}


def test_index_proposes_every_rule_that_matches():
    """Rules found by their rarest keyword are those that trying all of them finds."""
    rng, ruled = random.Random(14), license_scan.rules()
    indexed = license_scan.index(ruled)
    words = sorted({k for r in ruled for k in r.keywords}) + [b"the", b"x", b"2", b"0"]
    assert all(r.keywords for r in ruled)
    for _ in range(300):
        some = [rng.choice(words) for _ in range(40)]
        for text in rng.sample(list(LICENSED), 2):
            some[rng.randrange(40):0] = license_scan.alnum_words(text)
        every = [k for k, r in enumerate(ruled) if r.pattern.search(b" ".join(some))]
        assert set(every) <= set(license_scan.candidates(set(some), indexed))


def test_base_phrases_by_brute_force(spark):
    rng = random.Random(15)
    texts = list(ODD)
    for _ in range(200):
        some = [rng.choice(["cc", "BY", "by", "General", "public", "license", "all", "rights", "reserved", "é", "x"]) for _ in range(rng.randint(0, 40))]
        texts.append("".join(w + rng.choice([" ", "-", "\n", ", "]) for w in some))
    got = {r.doc_id: r for r in license_scan.scan(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        base = ",".join(sorted({label for _, label in places}))
        want = (len(words), len(places), min(starts, default=None), max(starts, default=None), base)
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want
        assert set(base.split(",")) - {""} <= set(got[i].labels.split(","))


@pytest.mark.parametrize("slice_words", [1_000_000, 15])
def test_proximity_by_brute_force(spark, slice_words):
    """All words of a window around its rarest one, in any order, near the ends of documents too."""
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(k, prose(rng, n, vocabulary)) for k, n in enumerate([25, 12, 3, 2, 1, 10])] + [(None, "w1 w2"), (9, "w1 absent")]
    texts = [prose(rng, rng.randint(0, 60), vocabulary) for _ in range(60)] + [None, ""]
    for _ in range(20):
        own = items[rng.randrange(6)][1].split()[:10]
        rng.shuffle(own)
        texts.append(prose(rng, rng.randint(0, 4)) + " " + " ".join(own) + " " + prose(rng, rng.randint(0, 4)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.contamination(documents(spark, texts), bench, slack=4, slice_words=slice_words).collect()
    split = [(t or "").split() for t in texts]
    frequency = Counter(w for t in split for w in set(t))
    want = []
    for t in split:
        found = set()
        for item, text in items:
            x = text.split()
            for window in [x[k : k + 10] for k in range(max(1, len(x) - 9))]:
                rarest = min(window, key=lambda w: frequency[w])
                near = any(set(window) <= set(t[max(0, p - 4) : p + 5]) for p, w in enumerate(t) if w == rarest)
                if near and item is not None:
                    found.add(item)
        want.append(len(found))
    assert [r.n_near_items for r in sorted(rows, key=lambda r: r.doc_id)] == want and 0 < sum(map(bool, want)) < len(want)


@pytest.mark.parametrize("slice_words", [1_000_000, 15])
def test_leaks_by_brute_force(spark, slice_words):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(1, prose(rng, 25, vocabulary)), (2, "W3, w4!"), (3, None), (None, prose(rng, 12, vocabulary)), (4, "")]
    texts = [prose(rng, 30, vocabulary) + " " + items[0][1] for _ in range(4)] + [prose(rng, 200, vocabulary) for _ in range(20)] + [items[3][1], None, ""]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contamination(documents(spark, texts), bench, slice_words=slice_words).collect()}
    for i, t in enumerate(texts):
        w, hit, names = (t or "").split(), set(), set()
        for item, text in items:
            x = [b.decode() for b in decontamination.alnum_words(text)]
            for win in [x[k : k + 10] for k in range(max(1, len(x) - 9))] if x else []:
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit |= set(range(k, k + len(win)))
                        names |= {str(item)} if item is not None else set()
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), digest, bool(hit))
    clean = {r.doc_id for r in decontamination.without_leaks(documents(spark, texts), bench).collect()}
    assert clean == {i for i in got if not got[i].contaminated}


def test_shards(spark):
    docs = documents(spark, [f"text {i}" for i in range(95)] + ODD).union(documents(spark, ["same"] * 3).selectExpr("cast(null as long)", "text", "lang", "source", "n_chars"))
    rows = sharding.shard(docs, shards=10).collect()
    by = Counter(r.shard for r in rows)
    assert len(rows) == 107 and max(by.values()) - min(by.values()) <= 1
    for s, n in by.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    again = sharding.shard(docs.repartition(7), shards=10).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    assert sharding.shard(docs.limit(0)).count() == 0


def test_shards_of_a_row_repeated_often(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 1000)
    docs = documents(spark, ["one", "two"]).unionByName(documents(spark, ["same"]).crossJoin(spark.range(12_345)).drop("id"))
    rows = sharding.shard(docs, shards=10).collect()
    assert sorted(r.number for r in rows) == list(range(12_347))
    assert len({(r.shard, r.slot) for r in rows}) == 12_347
    assert {r.slot * 10 + r.shard for r in rows} == set(range(12_347))


def test_pipeline_and_queries(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, d)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
    assert corpus_pipeline.run(spark, d).where("n_tokens <> size(ids)").count() == 0
    assert {n.split("_")[0] for n in queries()} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", ["op5_exact_top_k", "op9_decontamination"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from martwright.llm.queries import oracle_sql

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = queries()[name](spark, d)
    columns = ", ".join(sorted(df.columns))
    want = con.execute(f"SELECT {columns} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == sorted(want)


def test_top_k_counts_repeated_rows(spark):
    data = [(0, [1.0, 2.0]), *[(1, [1.0, 1.0])] * 3, (2, [0.5, 0.5])]
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>"), k=4).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 2)]


def test_words_merged_together_are_merged_as_alone():
    """Random words over pieces with equal scores, characters inside pieces only and characters of no piece."""
    chance = np.random.default_rng(5)
    scores = {"a": -9.0, "b": -9.0, "ab": -1.0, "ba": -1.0, "aa": -2.0, "aba": -3.0, "abab": -1.0, "ca": -2.0, "bca": -2.0, "▁a": -1.0}
    model = pieces.Model(True, {p: (k + 10, s) for k, (p, s) in enumerate(scores.items())}, [], list(range(256)), 0, True)
    words = sorted({"".join(chance.choice(list("aabbcx▁\U0001f600" if n % 2 else "ab"), n)) for n in chance.integers(1, 20, 3000)})
    alone = {w: np.array(pieces.encode_word(model, w), "<i4").tobytes() for w in words}
    together = pieces.Merges(model).encode(words)
    assert together == {w: alone[w] for w in together} and len(together) > 100
    assert {w for w in words if set(w) <= set("ab")} <= set(together) and len(together) < len(words)
    texts = [w.replace("▁", " ") for w in words] + [None, "", "a\nb\n a", "ab" * 200]
    table_ = pieces._Words(model, {})
    table_.most = 50
    got = list(table_.encode_all(texts))
    assert [g.tolist() for g in got] == [[i for w in pieces.words_of(t, True) for p in model.cuts.findall(w) for i in pieces.encode_word(model, p)] for t in texts]
    assert len(table_) == 50


@pytest.mark.parametrize("prefix", [True, False])
def test_keys_are_the_words_of_a_text(prefix):
    texts = [None, "", " ", "  ", "a", " a", "a ", "a b", "a  b", "▁a b▁", "▁", "a\nb\tc d", "\n", "é 日本 \0x", " \n  x "]
    for text in texts:
        keys = pieces.keys_of(text, prefix)
        assert [pieces._word(k) for k in keys] == pieces.words_of(text, prefix)
        assert [pieces._key(w) for w in pieces.words_of(text, prefix)] == keys


def test_strings_are_joined_in_bulk(monkeypatch):
    monkeypatch.setattr(pieces, "JOINED", 7)
    own = [b"", b"a", "é".encode(), b"12,", b"\xff" * 9]
    ids = np.random.default_rng(3).integers(0, len(own), 50).astype("<i4")
    for n in (0, 1, 7, 8, 50):
        assert pieces.Strings(own).joined(ids[:n]) == b"".join(own[i] for i in ids[:n])
