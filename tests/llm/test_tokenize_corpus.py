import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daywise.llm import tokenize_corpus as T


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def chunked(text, cuts):
    ends = [c for c in [*cuts, len(text)] if 0 < c <= len(text)]
    pieces = T.split_at_sure_places(text, sorted(set(ends)))
    assert "".join(a + b for a, b in pieces) == text
    return T.encode_pieces(pieces, T.TOKENIZERS, "byte_bpe_50k")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sltvre \n\t12.,中文é\xa0ก\x1c\x85\u0301²", max_size=80), st.lists(st.integers(1, 79), max_size=8))
def test_any_cuts_give_the_whole_encoding(whole, text, cuts):
    assert chunked(text, sorted(set(cuts))) == whole(text)


@pytest.mark.parametrize("text", [" " * 3000, "a" * 3000, "'" * 500 + "s", "x\n" * 900, "中" * 3000, "don't we'll " * 300])
def test_runs(whole, text):
    assert chunked(text, T.cuts_of([text])[0]) == whole(text)


def test_cuts_follow_content():
    rnd = random.Random(1)
    body = "".join(rnd.choice("abcdefgh ") for _ in range(20000))
    moved = "a few words before " + body
    cuts, ends = T.cuts_of([body, moved])
    assert [cuts] == T.cuts_of([body]) and T.cuts_of(["", "x", body, ""]) == [[], [1], cuts, []]
    own = {body[a:b] for a, b in zip([0, *cuts], cuts)}
    shared = {moved[a:b] for a, b in zip([0, *ends], ends)} & own
    assert len(shared) > 0.8 * len(own)


def test_documents(spark, whole):
    long = "The ward round was late. " * 4000
    rows = [(1, "Hello"), (2, ""), (3, None), (4, long), (5, long), (5, long), (6, "<|endoftext|>"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("mark", F.lit(0))
    got = {r.doc_id: r.ids for r in T.encode_documents(df).collect()}
    assert got == {i: whole(t) if t else [] for i, t in rows}
    assert T.encode_documents(df).count() == 7
    counts = {r.doc_id: r.n for r in df.select("doc_id", T.token_counts("text").alias("n")).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert T.encode_documents(df.limit(0)).count() == 0


def test_blocks_of_the_hash_propose_alike(monkeypatch):
    rnd = random.Random(3)
    points = T.np.array([rnd.randrange(97, 123) for _ in range(5000)], dtype=T.np.uint32)
    whole = T._proposed(points).tolist()
    monkeypatch.setattr(T, "BLOCK", 64)
    assert T._proposed(points).tolist() == whole


def test_reuse_counts_shared_cores(spark):
    rnd = random.Random(4)
    body = " ".join("".join(rnd.choice("aeiourst") for _ in range(5)) for _ in range(500))
    df = spark.createDataFrame([(i, f"Letter {i} begins here. {body}") for i in range(20)] + [(99, None)], "doc_id long, text string")
    r = T.reuse(df).first()
    assert r.documents == 21 and r.distinct_cores < r.cores / 5 and r.distinct_chars < r.core_chars / 5
    assert T.reuse(df.limit(0)).first().cores == 0
