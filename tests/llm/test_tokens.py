import base64

import pytest
import tiktoken

from tabulae.llm import tokens
from tabulae.llm.tokens import PATTERN, VOCABULARY, count_tokens, decode_ids, encode_texts, read_ranks, serialised_model

TEXTS = ["Hello world", "", None, " ", "\n\n  x", "naïve café", "<|endoftext|>", "emoji 🏭🌱", "x" * 30_000, "a b " * 5_000, "Группа 12.5 %", "tabs\t\r\n", "́combining", "\u0000\u0001"]
SCHEMA = "doc_id bigint, text string, ids string, key string"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(VOCABULARY), special_tokens={})


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def test_same_ids_and_round_trip(spark, reference):
    df = frame(spark, TEXTS)
    encoded = encode_texts(df)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in decode_ids(encoded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, ["doc_id"]).collect()} == {i: len(x) for i, x in got.items()}


def test_corpus(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = encode_texts(docs).collect()
    assert len(got) == len(texts) and all(list(r.ids) == (reference.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else []) for r in got)


def test_empty_and_forgetful(spark, monkeypatch):
    assert encode_texts(frame(spark, [])).count() == 0
    monkeypatch.setattr(tokens, "REMEMBERED", 0)
    enc = tokens.Encoder(VOCABULARY)
    assert enc.encode(["a b", "c d"]) == enc.encode(["a b", "c d"])


def test_gaps_are_refused():
    with pytest.raises(ValueError, match="gaps"):
        serialised_model({b"a": 0, b"b": 2})
    assert base64.b64encode(b"a")
