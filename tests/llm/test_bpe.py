import os
import random

import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from termloom.llm import bpe

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def other():
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=load_tiktoken_bpe(bpe.VOCABULARY), special_tokens={})


def texts():
    rng = random.Random(2)
    bits = ["a", "B", "é", "ß", "中文", "🙂", " ", "  ", "\n", "\t", "'s", "'ll", "'", "1", "٣", ".", ",", "--", " ", " ", "don't", "é", "​", "<|endoftext|>", "\x00", "the"]
    return ["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(1500)] + ["", "a" * 5000, " " * 3000, "word " * 20_000, "\n\n\n", "'", "'re", "x're y"]


def test_against_another_encoder(spark, other):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id bigint, text string, ids string, n_tokens int")
    out = bpe.encode_documents(df)
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in rows:
        r = got[i]
        assert r["ids"] == other.encode_ordinary(t), t[:80]
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
        at = 0
        for token, start in zip(r["ids"], r["starts"], strict=True):
            assert start == at
            at += len(other.decode_single_token_bytes(token))
        assert at == len(t.encode())
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(out).collect()}
    assert back == dict(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (None, "a"), (2, "")], "doc_id bigint, text string")
    rows = sorted((repr(r["doc_id"]), r["n_tokens"] is None, r["round_trip"], r["ids"] == []) for r in bpe.encode_documents(df).collect())
    assert rows == [("1", False, True, False), ("1", True, None, False), ("2", False, True, True), ("None", False, True, False)]
    assert bpe.encode_documents(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [64, None, -5, 10**9, 64])], "doc_id bigint, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode_documents(odd).collect()}
    assert got[1] is None and got[2] == "" and len(got[3]) == 2
    part = spark.createDataFrame([(1, [bpe.tokenizer(bpe.VOCABULARY).byte_id[b].item() for b in "aé".encode()[:2]]), (2, [64])], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(part).collect()}[1] == "a\ufffd"


def test_small_cache(monkeypatch, other):
    import pyarrow as pa

    from termloom.llm._text import buffers

    monkeypatch.setattr(bpe, "CACHE", 8)
    t = bpe.Tokenizer()
    for text in texts()[:200]:
        assert t.encode(*buffers(pa.array([text])))[0].tolist() == other.encode_ordinary(text)
