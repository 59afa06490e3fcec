import hashlib
import itertools
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import transducer as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
TRUTH = Tokenizer.from_file(PATH)
VOCABULARY = T.Vocabulary.read(PATH)
ENCODER, DECODER = T.Encoder(VOCABULARY), T.Decoder(VOCABULARY)


def ids(text):
    want = TRUTH.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(want)}I", *want)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_as_the_library_and_back(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ENCODER.encode(text) == ids(text)
    assert DECODER.decode(ENCODER.encode(text)).decode() == text


@pytest.mark.parametrize("text", ["", "\x00\x00", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "it's 'll 'r 're", "a" * 5000, " " * 3000 + "x", "x" + " " * 3000, "\n\n  x \x85\x1c", "😀é" * 50, "'" * 2000 + "s"])
def test_odd_texts(text):
    assert ENCODER.encode(text) == ids(text)


@settings(max_examples=100, deadline=None)
@given(st.text("ab'srel  \n1é!", max_size=80), st.integers(1, 7), st.integers(3, 9))  # a run is longer than a contraction
def test_pieces_of_any_size(text, size, run):
    old, T.RUN = T.RUN, run
    try:
        stream = T.Stream(ENCODER)
        got = b"".join([*(stream.feed(text[i : i + size]) for i in range(0, len(text), size)), stream.finish()])
    finally:
        T.RUN = old
    assert got == ids(text)


def test_long_text_of_few_spaces():
    r = random.Random(1)
    text = "".join(r.choice(["abc", "1", "é", "..", " ", "-", "   "]) * r.choice([1, 1, 1, 900]) for _ in range(700))
    assert len(text) > 2 * T.PIECE and ENCODER.encode(text) == ids(text)
    assert DECODER.decode(ENCODER.encode(text)).decode() == text


def test_memory_stays_constant():
    one, most, out = T.Transducer(VOCABULARY), 0, 0
    for _ in range(300):
        out += len(one.feed(b"abcdefgh" * 64))
        most = max(most, len(one.held))
    assert most < one.window + 1 and out > 1000


def random_merges(r, n):
    made, merges = [b"a", b"b", b"c"], []
    while len(merges) < n:
        a, b = r.choice(made), r.choice(made)
        if len(a + b) <= 6 and a + b not in made:
            made.append(a + b)
            merges.append((a, b))
    return merges


def plain(word, merges):
    """Each merge in turn, from left to right."""
    tokens = [bytes([b]) for b in word]
    for a, b in merges:
        out = []
        for t in tokens:
            if out and out[-1] == a and t == b:
                out[-1] = a + b
            else:
                out.append(t)
        tokens = out
    return tokens


def cuts(tokens, upto):
    return {e for e in itertools.accumulate(map(len, tokens)) if e <= upto}


@pytest.mark.parametrize("seed", range(12))
def test_lookahead_suffices(seed):
    """Against all continuations: what ends ``lookahead`` before the end of the beginning never changes."""
    r = random.Random(seed)
    merges = random_merges(r, 9)
    far = T.lookahead(merges)
    for _ in range(60):
        x = bytes(r.choices(b"abc", k=far + r.randrange(12)))
        upto = len(x) - far
        want = cuts(plain(x, merges), upto)
        for n in range(5):
            for y in itertools.product(b"abc", repeat=n):
                assert cuts(plain(x + bytes(y), merges), upto) == want


def test_transducer_against_plain_merges():
    for seed in range(30):
        r = random.Random(seed)
        merges = random_merges(r, 12)
        names = {bytes([b]): b for b in range(256)} | {a + b: 256 + k for k, (a, b) in enumerate(merges)}
        vocabulary = T.Vocabulary(names, merges)
        word = bytes(r.choices(b"abc", k=400))
        one, got = T.Transducer(vocabulary, step=8), []
        for i in range(0, 400, 3):
            got += one.feed(word[i : i + 3])
        assert [vocabulary.pieces[i] for i in got + one.finish()] == plain(word, merges)


def test_merges_must_be_in_order():
    with pytest.raises(ValueError):
        T.lookahead([(b"ab", b"c"), (b"a", b"b")])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30), st.integers(1, 4))
def test_any_ids_decode_as_the_library(numbers, size):
    want = TRUTH.decode(numbers, skip_special_tokens=False)
    packed = struct.pack(f"<{len(numbers)}I", *numbers)
    assert DECODER.decode(packed).decode() == want
    one = T.Decoder(VOCABULARY)
    assert "".join(one.feed(packed[i : i + 4 * size]) for i in range(0, len(packed), 4 * size)) + one.feed(b"", True) == want


def test_query_shape(spark):
    rows = [(1, "Hello there", "x", 1), (2, None, "y", None), (2, None, "y", 2), (None, "", "z", 3), (3, "x y" * 70_000, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    bpe = T.StreamingBpe(spark, PATH)
    out = {(r.doc_id or 0): r for r in T.digests(df, bpe).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert [out[i].n_tokens for i in (0, 1, 2, 3)] == [0, 2, 0, len(ids("x y" * 70_000)) // 4]
    assert out[0].ids_sha256 == out[2].decoded_sha256 == empty
    assert out[3].decoded_sha256 == hashlib.sha256(b"x y" * 70_000).hexdigest()
    for wide in (bpe.decode(bpe.encode(df)), bpe.both(df)):
        r = wide.where("doc_id = 1").first()
        assert r.decoded == "Hello there" and bytes(r.ids) == ids("Hello there") and len(set(wide.columns)) == len(wide.columns)
    assert T.digests(df.limit(0), bpe).count() == 0


def test_whole_table_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in T.digests(docs, T.StreamingBpe(spark, PATH)).collect()}
    for d in docs.select("doc_id", "text").collect():
        r, packed = got[d.doc_id], ids(d.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(packed) // 4, hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
