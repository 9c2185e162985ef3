"""Byte-pair encoding against the library that the vocabulary is for."""

import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS, THEIRS = bpe.ByteBPE(PATH), Tokenizer.from_file(PATH)
TEXTS = ["", " ", "a <|endoftext|> b<|endoftext|>é퟿  x", "a" * 3001, "   \n\n  a", "日本語 emoji 😀😀 test\x00\x01", "don't we'll I'VE 'S", "  x \u0085y", "-" * 400, "word " * 300_000]


def theirs(text):
    return THEIRS.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_random_texts(texts):
    for text, ids in zip(texts, OURS.encode_all(texts), strict=True):
        assert ids.tolist() == theirs(text)
        assert OURS.decode(ids) == text


def test_chosen_texts_and_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    for text, ids in zip(TEXTS, OURS.encode_all(TEXTS), strict=True):
        assert ids.tolist() == theirs(text)
        assert OURS.decode(ids) == THEIRS.decode(ids.tolist(), skip_special_tokens=False)


def test_query_shape(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS[:-1]), (1, None), (1, " ")], "doc_id long, text string").selectExpr("*", "5 as n_tokens", "'x' as ids")
    rows = sorted(bpe.bpe_round_trip(docs, PATH).collect())
    assert len(rows) == len(TEXTS) + 1
    want = sorted((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in [*enumerate(TEXTS[:-1]), (1, None), (1, " ")] for x in [theirs(t or "")])
    assert [tuple(r) for r in rows] == want
    encoded = bpe.bpe_encode(docs, PATH)
    assert sorted(r["text"] for r in bpe.bpe_decode(encoded, PATH).collect()) == sorted(t or "" for t in [*TEXTS[:-1], None, " "])
    assert bpe.bpe_encode(docs.limit(0), PATH).count() == 0
