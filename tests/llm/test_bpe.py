import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary here")
RANKS = bpe.read_ranks() if os.path.exists(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken") else {}
ENC = bpe.PairIndexBpe(RANKS) if RANKS else None


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=6))
def test_round_trip_and_one_at_a_time(texts):
    for t, ids in zip(texts, ENC.encode_batch(texts)):
        assert b"".join(ENC.token[i] for i in ids).decode("utf-8", "surrogatepass") == t
        assert ids == [i for w in ENC.split(t) for i in ENC.one_by_one(w.encode("utf-8", "surrogatepass"))]


def test_equals_the_public_library(public, spark, sf):
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r[0]]
    texts += ["<|endoftext|>", "aaaaaaaaaa" * 500, " \n\n\t x", "it's 'll", "日本語 é é ​", "x"]
    assert ENC.encode_batch(texts) == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


def test_frame(spark):
    df = spark.createDataFrame([(1, "the mill", [1]), (2, None, [2]), (3, "", [3]), (1, "the mill", [1])], "doc_id long, text string, ids array<int>")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.with_token_ids(df, "text", ["doc_id"]).collect())
    one = ENC.encode_batch(["the mill"])[0]
    assert got == [(1, one), (1, one), (2, []), (3, [])]
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.with_token_counts(df, "text", ["doc_id"]).collect()} == {1: len(one), 2: 0, 3: 0}
    assert bpe.with_token_ids(df.limit(0), "text", ["doc_id"]).count() == 0


def test_a_merge_of_lower_rank_falls_back():
    ranks = {bytes([i]): i for i in range(256)} | {b"abcd": 256, b"bc": 257, b"abc": 258}
    e = bpe.PairIndexBpe(ranks)
    assert e.encode_words(["abcd", "abc"]) == [e.one_by_one(b"abcd"), e.one_by_one(b"abc")]


def test_one_by_one_equals_the_plain_rule():
    import random
    import time

    enc = bpe.PairIndexBpe(bpe.read_ranks())

    def plain(raw):
        ids = [enc.byte[c] for c in raw]
        while len(ids) > 1:
            r, i = min(((r if (r := enc.rank(a, b)) >= 0 else 1 << 60), i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
            if r == 1 << 60:
                break
            ids[i : i + 2] = [r]
        return ids

    rng = random.Random(3)
    for _ in range(300):
        raw = bytes(rng.choice(b"abeinorst \xc3\xa9aaa") for _ in range(rng.randrange(0, 60)))
        assert enc.one_by_one(raw) == plain(raw)
    t = time.time()
    assert b"".join(enc.token[i] for i in enc.one_by_one(b"anaerobic" * 20_000)) == b"anaerobic" * 20_000 and time.time() - t < 20
