import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
CODEC = bpe.Codec(bpe.serialise_model(RANKS), public_tokenizers.PATTERN, RANKS)
TRUTH = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    want = TRUTH.encode_ordinary(text)
    return struct.pack(f"<{len(want)}I", *want)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_as_tiktoken_and_back(text):
    text = text.encode("utf-8", "ignore").decode()
    assert CODEC.encode(text) == ids(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["", "\x00\x00", "<unk> <s> ▁▁x", "<|endoftext|>", "a" * 3000, " \n\n  x ", "😀é" * 50])
def test_odd_texts(text):
    assert CODEC.encode(text) == ids(text)


def test_ranks_must_be_whole():
    with pytest.raises(ValueError):
        bpe.serialise_model({b"a": 0})


def test_query_shape(spark):
    rows = [(1, "Hello there", "x"), (2, None, "y"), (2, None, "y"), (None, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.digests(df, bpe.ByteBpe(spark, PATH, public_tokenizers.PATTERN)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 0), (1, len(TRUTH.encode_ordinary("Hello there"))), (2, 0), (2, 0)]
    assert all(r.decoded_sha256 == empty for r in out if r.doc_id != 1)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Hello", "x", "y")], "doc_id long, text string, ids string, decoded string")
    codec = bpe.ByteBpe(spark, PATH, public_tokenizers.PATTERN)
    for out in (codec.decode(codec.encode(df)), codec.both(df)):
        r = out.collect()[0]
        assert bytes(r.decoded) == b"Hello" and bytes(r.ids) == ids("Hello") and len(set(out.columns)) == len(out.columns)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(df, bpe.ByteBpe(spark, PATH, public_tokenizers.PATTERN)).count() == 0
