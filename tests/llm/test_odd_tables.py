"""Every text operator and every stage of the pipeline on odd tables: nulls in all columns, empty
and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
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
from martwright.llm.queries import ship

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, beside the tables' own.
CLASHING = (
    "own uid row key head low high n run content copies bucket number first score predicted held_out quality toxic "
    "labelled_id digest rank tie component kept ids word piece hits items label rule shape template fp least_id lang_pred "
    "size shard slot text_crc32 dim tree kept_sha256 n_words query_id"
).split()


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def clash(df):
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING if c not in df.columns])


def rows():
    rng = random.Random(5)
    plain = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    long = " ".join(str(rng.random()) for _ in range(60_000))
    return [
        (None, None, None, None, None),
        (None, plain, None, None, None),
        (1, None, "en", "s", 0),
        (2, "", "en", "s", 0),
        (3, " \n\t", "en", "s", 3),
        (4, plain, "en", "s", len(plain)),
        (4, plain, "en", "s", len(plain)),
        (5, plain.upper(), "de", None, 7),
        (6, long, "de", "s", len(long)),
        (7, "x" * 300_000, None, "s", 1),
        (8, "日本語 ▁ \x00 🎉", "ja", "s", 9),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return clash(spark.createDataFrame(rows(), DOC).repartition(3))


@pytest.fixture(scope="module")
def labels(spark):
    data = [(4, 1, 0), (4, 0, 0), (6, 0, None), (7, None, 1), (None, 1, 1), (99, 1, 0), (3, 1, 0)]
    return clash(spark.createDataFrame(data, "doc_id long, quality int, toxic int").select("doc_id", "quality", "toxic"))


@pytest.fixture(scope="module")
def benchmark(spark):
    data = [(None, None), ("a", None), ("b", ""), ("c", "日本語"), ("c", "日本語"), (None, "🎉")]
    return clash(spark.createDataFrame(data, "item_id string, text string"))


def operators(labels, benchmark, model):
    """Operators that return one row per document."""
    return {
        "op2": lambda d: quality_classifier.classify(d, labels),
        "op3": simhash.near_duplicates,
        "op4": suffix_dedup.remove_repeats,
        "op6": lambda d: language_id.identify(d, language_id.train(d)),
        "op7": lambda d: pieces.summary(d, model),
        "op8": license_scan.scan,
        "op9": lambda d: decontamination.contamination(d, benchmark),
        "op10": lambda d: sharding.shard(d, shards=3),
    }


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10"])
def test_documents(odd, labels, benchmark, model, name):
    run = operators(labels, benchmark, model)[name]
    got = run(odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows())
    assert run(odd.limit(0)).collect() == []
    nothing = {r["doc_id"]: r for r in got}
    if name == "op2":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    if name == "op3":
        assert nothing[1]["fingerprint"] == nothing[2]["fingerprint"] == nothing[3]["fingerprint"] == "0" * 16
        assert nothing[1]["component_id"] == 1 and nothing[4]["component_id"] == nothing[5]["component_id"] == 4
    if name == "op4":
        assert nothing[1]["n_bytes"] == nothing[1]["n_removed"] == 0 and nothing[7]["n_removed"] == 300_000
        assert {r["n_removed"] for r in got if r["doc_id"] == 4} == {479}
    if name == "op6":
        assert nothing[1]["lang_pred"] == nothing[2]["lang_pred"] == nothing[3]["lang_pred"] == "und"
    if name == "op7":
        assert all(r["round_trip"] for r in got) and nothing[1]["n_tokens"] == nothing[2]["n_tokens"] == 0
    if name == "op8":
        assert nothing[1]["n_words"] == 0 and nothing[1]["labels"] == "" and nothing[1]["first_word"] is None
    if name == "op9":
        assert [r["doc_id"] for r in got if r["contaminated"]] == [8]
        assert nothing[8]["n_hit"] == 2 and nothing[8]["n_items"] == 1
    if name == "op10":
        assert nothing[1]["size"] == 16 and nothing[1]["text_crc32"] == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, labels, benchmark, model, monkeypatch, stage):
    tables = {"labels": labels, "benchmark": benchmark}
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, d, name: tables[name])
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, odd, "unused")
    assert run(spark, odd.limit(0), "unused").count() == 0
    if stage == "pieces":
        assert got.count() == len(rows()) and got.where("ids is null or n_tokens <> size(ids)").count() == 0
        return
    assert got.columns == odd.columns
    left = got.collect()
    assert all(r[c] == f"extra {c}" for r in left for c in CLASHING)
    if stage == "near_dedup":
        assert {r["doc_id"] for r in left} == {1, 4, 6, 7, 8} and len(left) == 5
    if stage == "repeats":
        texts = {r["doc_id"]: r["text"] for r in left}
        assert len(left) == len(rows()) and texts[4] == "" and texts[1] is None and len(texts[7]) == 300_000
    if stage == "decontamination":
        assert sorted(str(r["doc_id"]) for r in left) == sorted(str(r[0]) for r in rows() if r[0] != 8)


def test_pages(spark):
    data = [(1, None), (None, "no scheme"), (2, ""), (3, "http://"), (4, "x://A.NET/" + "y/" * 5000), (4, "x://A.NET/"), (4, "x://A.NET/"), (5, "a://b//?://c.net/")]
    pages = clash(spark.createDataFrame(data, "page_id long, url string"))
    got = url_filters.judge(pages).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(i) for i, _ in data)
    assert {(r.host, r.path) for r in got if r.page_id in (None, 1, 2, 3)} == {("", "")}
    assert {(r.host, r.rule, r.verdict) for r in got if r.page_id == 4} == {("a.net", "net/", "block")}
    assert url_filters.judge(pages.limit(0)).collect() == []


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    data = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [1.0, 1.0]), (100, None), (200, [None, 1.0]), (300, [inf, 1.0]), (400, [nan, 1.0]), (2, [1.0, 1.0]), (1, [1.0, 1.0]), (500, []), (3, [5.0])]
    vectors = clash(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in topk.top_k(vectors).collect())
    assert got == [(0, 1, 1, 3 * 1024**2), (0, 2, 2, 3 * 1024**2)]
    assert topk.top_k(vectors.limit(0)).collect() == []
