import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import alignment
from lectern.llm.common import Scratch
from lectern.llm.transducer import Vocabulary, printable

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
A.encode_special_tokens = True
ALIGNER = alignment.Aligner(Vocabulary.read(JSON, special=False), B.serialized_model_proto())
BYTE = {printable(b): b for b in range(256)}


def brute(text):
    """The groups of one text, as lists of ids, by plain walking; None without tokens."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    bytes_a = [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a]
    pieces = [B.id_to_piece(i) for i in b]
    bytes_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    groups, i, j, x, y = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y:
            groups[-1][0].append(a[i])
            x, i = x + len(bytes_a[i]), i + 1
        else:
            groups[-1][1].append(b[j])
            y, j = y + len(bytes_b[j]), j + 1
        if x == y and (i < len(a) or j < len(b)):
            groups.append(([], []))
    return groups


def spell(groups):
    return ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups) if groups else ""


TEXTS = ["", None, " ", "a ", "  a  b ", "it's ▁ here", "naïve café 12345 \n\n\tx", "<s> <0x0A> <|endoftext|>", "日本語のテキスト", "😀" * 9, "a" * 400, "x\x00y", "the the the"]


@pytest.mark.parametrize("text", TEXTS)
def test_groups_of_odd_texts(text):
    (one,) = ALIGNER.align([text])
    assert one["written"] == spell(brute(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_groups_of_any_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for one, text in zip(ALIGNER.align(texts), texts, strict=True):
        groups = brute(text)
        assert one["written"] == spell(groups)
        keys = ALIGNER.pairs.keys[one["links"]]
        assert [(k // ALIGNER.pairs.width, k % ALIGNER.pairs.width) for k in keys.tolist()] == [(g[0][-1], g[1][-1]) for g in groups or []]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=40))
def test_union_find(n, edges):
    edges = [(a % n, b % n) for a, b in edges]
    want = list(range(n))
    for _ in range(n):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = alignment.components(n, *(np.array([e[k] for e in edges], np.int64) for k in (0, 1)))
    assert got.tolist() == want


def test_components_are_minimal_groups():
    r = np.random.default_rng(3)
    for _ in range(50):
        n = int(r.integers(2, 60))
        ends_a, ends_b = (np.unique(np.append(r.integers(1, n + 1, int(r.integers(1, 40))), n)) for _ in range(2))
        root = alignment.components(ends_a.size + ends_b.size, *(lambda x, y: (x, y + ends_a.size))(*alignment.overlaps(ends_a, ends_b)))
        both = np.intersect1d(ends_a, ends_b)
        want = np.concatenate((np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)))
        assert np.array_equal(np.unique(root, return_inverse=True)[1], want)


def test_pairs_are_bounded():
    assert ALIGNER.pairs.keys.size <= sum(map(len, ALIGNER.bytes_a)) + sum(map(len, ALIGNER.bytes_b)) < 1_000_000


def expected(rows):
    """The whole result by brute force, from (doc_id, text)."""
    told = [(d, brute(t)) for d, t in rows]
    count = Counter((g[0][-1], g[1][-1]) for _, groups in told for g in groups or [])
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for d, groups in told:
        links = [(g[0][-1], g[1][-1]) for g in groups or []]
        out.append((d, sum(len(g[0]) for g in groups or []), sum(len(g[1]) for g in groups or []), len(links), len(links), sum(count[k] == top[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(spell(groups).encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def test_small_table(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a "), (None, "the end"), (99, "word " * 30_000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, links string, n_a int")
    cross = alignment.CrossTokenizer(spark, JSON, MODEL)
    assert sorted(map(tuple, alignment.digests(df, cross, Scratch(spark, "t")).collect()), key=str) == expected(rows)
    wide = cross.align(df, written=True)
    assert len(set(wide.columns)) == len(wide.columns) and wide.where("doc_id = 3 AND links IS NOT NULL").first().groups == spell(brute("a "))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.digests(df, alignment.CrossTokenizer(spark, JSON, MODEL), Scratch(spark, "t")).count() == 0


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = alignment.digests(docs, alignment.CrossTokenizer(spark, JSON, MODEL), Scratch(spark, "t"))
    assert sorted(map(tuple, got.collect()), key=str) == expected([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("text", ["word " * 300, "a  b \n c" * 200 + " ", "noblank" * 300, "x y" * 400 + "▁ z"])
def test_long_texts_in_parts(text, monkeypatch):
    whole = list(ALIGNER.rows([text, "a b"], True))
    monkeypatch.setattr(alignment, "TOGETHER", 100)
    assert list(ALIGNER.rows([text, "a b"], True)) == whole
    assert whole[0][6] == spell(brute(text))
