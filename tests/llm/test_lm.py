import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lectern.llm import lm
from lectern.llm.blocks import Block
from lectern.llm.common import Scratch

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(t):
    return [*WORD.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode())), None]


def brute(rows):
    """The interpolated trigram formula token by token; no states and no failures."""
    train = [tokens(t) for d, t in rows if zlib.crc32(b"" if d is None else str(d).encode()) % 5 != 1]
    c = [Counter() for _ in range(4)]
    for t in train:
        t = ["start", *t]
        for k in (1, 2, 3):
            c[k].update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    starts = c[1].pop(("start",), 0)
    n, v = sum(c[1].values()), len(c[1])

    def p(history, w):
        if not history:
            return (c[1][(w,)] + 0.5) / (n + 0.5 * (v + 1))
        before = starts if history == ("start",) else c[len(history)][history]
        return (c[len(history) + 1][(*history, w)] + lm.MU * p(history[1:], w)) / (before + lm.MU)

    out = []
    for d, t in rows:
        words = tokens(t)
        whole = ["start", *words]
        score = sum(math.log10(p(tuple(whole[max(0, i - 2) : i]), whole[i])) for i in range(1, len(whole)))
        held = zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
        out.append((str(d), held, len(words), sum(c[1][(w,)] > 0 for w in words), n, sum(math.log10(p((), w)) for w in words), score))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(df, Scratch(spark, "t")).collect())


@pytest.mark.parametrize("piece", [512, 5])
def test_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(lm, "PIECE", piece)
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' WHERE doc_id < 60").fetchall()
    rows += [(1000, None), (1001, ""), (1001, ""), (None, "The THE the É"), (1002, " \t\x0b a\x00b \n"), (1003, "x " * 3000)]
    got, want = run(spark, rows), brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], abs=1e-4)


def hand_built():
    """A small model as such files list it: log10 probabilities and backoff weights, with the textbook's rule for unseen n-grams."""
    probability = {("a",): -0.5, ("b",): -0.7, ("end",): -0.9, ("unknown",): -2.0, ("start", "a"): -0.2, ("a", "b"): -0.3, ("b", "end"): -0.1, ("a", "a"): -0.6, ("a", "b", "end"): -0.05, ("start", "a", "b"): -0.15}
    backoff = {("start",): -0.4, ("a",): -0.25, ("b",): -0.35, ("start", "a"): -0.11, ("a", "b"): -0.12, ("a", "a"): -0.13, ("b", "end"): 0.0}
    return probability, backoff


def by_the_book(probability, backoff, history, word):
    if (*history, word) in probability:
        return probability[(*history, word)]
    return backoff.get(history, 0.0) + by_the_book(probability, backoff, history[1:], word)


def test_automaton_of_a_hand_built_model():
    probability, backoff = hand_built()
    words = ["a", "b", "end", "unknown"]
    states = [(), ("start",), ("a",), ("b",), ("start", "a"), ("a", "b"), ("a", "a"), ("b", "end")]
    number = {s: i for i, s in enumerate(states)}

    def longest(text):
        return next(number[tuple(text[k:])] for k in range(len(text) + 1) if tuple(text[k:]) in number)

    arcs = [(number[g[:-1]], words.index(g[-1]), w, longest(g[-2:])) for g, w in probability.items() if len(g) > 1]
    state, word, weight, to = (np.array(x) for x in zip(*arcs, strict=True))
    auto = lm.Automaton(
        state, word, weight, to.astype(np.int32), np.array([probability[(w,)] for w in words]), np.array([longest((w,)) for w in words], np.int32),
        np.array([backoff.get(s, 0.0) for s in states]), np.array([longest(s[1:]) if s else 0 for s in states], np.int32),
    )
    rng = random.Random(2)
    texts = [[rng.choice(["a", "a", "b", "unknown"]) for _ in range(rng.randrange(12))] + ["end"] for _ in range(60)]
    counts = np.array([len(t) for t in texts])
    got = auto.traverse(np.array([words.index(w) for t in texts for w in t]), np.cumsum(counts) - counts, counts)
    want = [by_the_book(probability, backoff, tuple((["start", *t])[max(0, i - 1) : i + 1]), w) for t in texts for i, w in enumerate(t)]
    assert got == pytest.approx(want)


def test_each_state_sums_to_one():
    """Over the training words and one unknown word, from each state that a block's texts reach."""
    texts = ["a b a b c", "b a c c", "a b c d", "", "d d d d a"]
    block = Block.__new__(Block)
    block.texts, block.ids = [*(t.encode() for t in texts), b"zzz"], [0, 1, 2, 3, 4, 5]
    t = lm.Tokens(block, lambda i: i < 5)
    t.ngrams()
    count, pairs = np.bincount(t.of, t.in_training), np.bincount(t.pair_of, t.in_training)
    triples = np.bincount(t.triple_of, t.in_training[t.inner])
    auto = lm.automaton(t, count, pairs, triples, int(count.sum()), int((count > 0).sum()))
    for state in range(auto.fail_to.size):
        added, _ = auto.step(np.full(auto.words, state, np.int32), np.arange(auto.words))
        assert (10.0**added).sum() == pytest.approx(1.0)


def test_ngrams_help_on_held_out(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    held = [r for r in run(spark, rows) if r[1]]
    assert len(held) > 100 and sum(r[6] for r in held) > sum(r[5] for r in held)


def test_what_it_gathers_grows_with_the_input(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert run(spark, rows)[0][4] > run(spark, rows[:100])[0][4]


def test_empty_and_no_training(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark, "t")).count() == 0
    df = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(df, Scratch(spark, "t"), lambda d: False).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and math.isfinite(got[1].score)
