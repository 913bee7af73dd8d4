"""Chat formatting and the prefix trie against plain Python, on odd and random tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from martwright.llm import chat_format, prefix_trie
from martwright.llm.queries import ship

CONVERSATION = "conv_id long, turn long, role string, text string"
CLASHING = (
    "t turns blocks starts parts pieces formatted loss_mask learned pos digest bytes depth hi lo parent_hi parent_lo ends cum "
    "least weight total tail spent once leaf counts_from counted block part conv key node n_convs n_leaves"
).split()
TEXTS = [
    None, "", "hello", "hello\nworld", "<|im_end|>", "<|im_end|>\n<|im_start|>assistant<|im_sep|>x", r"<\|im_sep|>", r"<\\|",
    "<|", "<", "|", "<<||>", r"\<|\|", "日本語 🎉", "x" * 300, "\n", r"ends in <", r"| begins", r"<\ |",
]
ROLES = ["user", "assistant", "assistant", "system", None, "", "odd\nrole", "<|im_sep|>", "<\\|"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def clash(df):
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING if c not in df.columns])


def by_conversation(rows):
    """The turns of each conversation as (role, text), in order."""
    found = defaultdict(list)
    for c, turn, role, text in rows:
        found[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in found.items()}


def odd_rows(seed, convs=40):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(convs)]:
        for k in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([k, k, k, None, 3]), rng.choice(ROLES), rng.choice(TEXTS)))
    return rows + rows[:5]


# --- chat formatting -------------------------------------------------------------------------


def mark(text):
    """Escaping written as a scanner."""
    out, k = [], 0
    while k < len(text):
        end = k + 1
        if text[k] == "<":
            while end < len(text) and text[end] == "\\":
                end += 1
            if end < len(text) and text[end] == "|":
                out.append("<\\")
                k += 1
                continue
        out.append(text[k])
        k += 1
    return "".join(out)


def written(turns):
    out, before = [], None
    for k, (role, text) in enumerate(turns):
        if k and role == before:
            out.append("<|im_sep|>" + mark(text))
        else:
            out.append(("<|im_end|>\n" if k else "") + f"<|im_start|>{mark(role)}<|im_sep|>{mark(text)}")
        before = role
    return "".join(out) + "<|im_end|>\n"


@pytest.mark.parametrize("seed", [1, 2])
def test_formatting_by_brute_force(spark, seed):
    rows = odd_rows(seed)
    df = clash(spark.createDataFrame(rows, CONVERSATION).repartition(3))
    formatted = chat_format.format_conversations(df)
    want = by_conversation(rows)
    texts = {r.conv_id: r for r in formatted.collect()}
    assert {c: r.formatted for c, r in texts.items()} == {c: written(t) for c, t in want.items()}
    for c, turns in want.items():
        at, spans = 0, []
        for m in texts[c].loss_mask:
            at += m.skip
            spans.append((texts[c].formatted[at : at + m.chars], m.loss))
            at += m.chars
        assert spans == [(mark(text), role == "assistant") for role, text in turns]
        assert texts[c].formatted[at:] == "<|im_end|>\n"
    read = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.parse(formatted).collect()}
    assert read == want
    for r in chat_format.digest(formatted).collect():
        turns = want[r.conv_id]
        learned = "".join(text for role, text in turns if role == "assistant")
        lines = "".join(f"{role}\n{text}\n" for role, text in turns)
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars == len(written(turns))


def test_no_conversations(spark):
    none = spark.createDataFrame([], CONVERSATION)
    assert chat_format.digest(chat_format.format_conversations(none)).collect() == []
    assert prefix_trie.prefix_trie(none).collect() == []


def test_a_mask_that_does_not_fit_is_an_error(spark):
    df = spark.createDataFrame([(1, 0, "user", "some text")], CONVERSATION)
    other = chat_format.format_conversations(df).withColumn("formatted", F.regexp_replace("formatted", "some", "a"))
    with pytest.raises(Exception, match="mask does not fit"):
        chat_format.digest(other).collect()


def test_formatting_is_one_shuffle_without_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], CONVERSATION)
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = chat_format.digest(chat_format.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
    assert plan.count("ObjectHashAggregate") == 2 and "element_at(turns#" in plan  # turns are sorted once, not for each turn


# --- prefix trie -----------------------------------------------------------------------------


def rebuilt(rows):
    own = by_conversation([r for r in rows if r[0] is not None])
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        found[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return found


def trie(sequences):
    """Every node by its sequence, walked one by one."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    found = set()
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(own) if len(sequences[c]) == len(node))
        found.add(
            (
                min(own), len(node), min(members[node[:-1]]) if node else None, len(own),
                sum(len(n) == len(node) + 1 for n in below),
                sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members) for n in below),
                saved, hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return found


def check_trie(spark, rows):
    got = prefix_trie.prefix_trie(clash(spark.createDataFrame(rows, CONVERSATION).repartition(3))).collect()
    want = trie(rebuilt(rows))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trie_by_brute_force(spark):
    """Few texts, so that many conversations share prefixes, end inside others or are equal."""
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 90), *range(-12, 0), 2**63 - 1, 2**63 - 3, -(2**63), None]:
        for k in range(rng.randrange(1, 12)):
            rows.append((c, k, "user" if k % 2 else rng.choice(["assistant", None]), rng.choice(["é", "", None, "b" * 5])))
    check_trie(spark, rows)


def test_trie_with_missing_bases_ties_free(spark):
    rng = random.Random(4)
    rows = [(c, rng.choice([None]) if k == 0 else k, "a", f"t{k % 3}") for c in range(1, 200, 3) for k in range(rng.randrange(1, 6))]
    check_trie(spark, rows)


def test_end_lists_of_many(spark, monkeypatch):
    """Equal conversations over many rows of an end list, in numerical order."""
    monkeypatch.setattr(prefix_trie, "ENDS", 7)
    rows = [(c, 0, "user", "same") for c in range(5, 400)]
    check_trie(spark, rows)


def test_a_long_conversation(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        check_trie(spark, [(c, k, "user", str(k % 7)) for c in (2, 7, 9) for k in range(130)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
