"""Tokens against the public library that ships the vocabulary."""

import base64
import random

import pytest

from ledgerloom.llm import tokenise

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    path = tokenise.vocabulary_path()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenise.PIECES, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(reference):
    enc = tokenise.Encoder(tokenise.vocabulary_path(), remembered=50)
    rng = random.Random(3)
    letters = " \t\n\r\x0b\x1c\x85\xa0 ​aéß字漢😀1٣².,'s t'll  thequickbrown"
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert enc.encode(text) == reference.encode_ordinary(text)


def test_long_pieces_and_ties(reference):
    enc = tokenise.Encoder(tokenise.vocabulary_path())
    for text in ("a" * 5000, "ab" * 3000, "字漢語" * 2000, "-" * 4001, " " * 3000, "0123456789" * 300, "<|endoftext|>"):
        assert enc.encode(text) == reference.encode_ordinary(text)


def test_corpus(spark, data, reference):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in tokenise.encode_corpus(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == {r["doc_id"]: reference.encode_ordinary(r["text"] or "") for r in rows}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokenise.token_counts(docs, "doc_id").collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_null_empty_repeated(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x")], "doc_id bigint, text string, ids string")
    assert sorted((r["doc_id"], r["ids"]) for r in tokenise.encode_corpus(df).collect()) == [(1, []), (2, []), (3, [64, 275]), (3, [64, 275])]
    assert tokenise.encode_corpus(df.limit(0)).count() == 0
