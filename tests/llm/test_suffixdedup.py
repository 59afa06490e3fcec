import hashlib
import random
import tracemalloc

import duckdb
import numpy as np
import pytest

from lectern.llm import induced, suffixdedup
from lectern.llm.common import Scratch


def brute(rows, width=50):
    docs = [(d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, t in docs:
        for i in range(len(t) - width + 1):
            if d is not None:
                least[t[i : i + width]] = min(d, least.get(t[i : i + width], d))
    out = []
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if d is not None and least[t[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((str(d), len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, b"") for r in rows], "doc_id long, text string, kept binary").repartition(5)
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.digests(df, Scratch(spark, "t")).collect())


@pytest.mark.parametrize("hot,base", [(2_048, 1 << 22), (2_048, 8), (1, 1 << 22)])
def test_brute_force(spark, monkeypatch, hot, base):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    monkeypatch.setattr(induced, "BASE", base)
    rng = random.Random(6)
    word = lambda: rng.choice(["the ", "of ", "é ", "日本 "] + [f"w{i} " for i in range(50)])
    passage = "".join(word() for _ in range(50))
    rows = [(0, None), (1, ""), (2, "a" * 300), (3, "a" * 120 + "b" + "a" * 60), (4, "ab" * 90), (None, passage), (5, passage[:49])]
    for i in range(10, 70):
        text = "".join(word() for _ in range(rng.randrange(0, 60)))
        rows.append((i, text + passage[rng.randrange(30) : rng.randrange(60, 200)] + text[:40] if i % 3 else text))
    rows += [(5, rows[20][1]), (99, rows[30][1] + "x"), (99, rows[30][1] + "x"), (98, rows[31][1] * 2)]
    assert run(spark, rows) == brute(rows)


def test_given_documents(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


VOCABULARY = ["the", "of", "é", "日本"] + [f"w{i}" for i in range(3_000)]


def prose(rng, n):
    return " ".join(rng.choices(VOCABULARY, k=n)).encode()


def test_runs_by_steps(monkeypatch):
    """Runs are the same whatever a step's places, and two agree in hash if they agree in bytes."""
    rng = random.Random(8)
    texts = [prose(rng, 80), b"", b"ab" * 300, b"a" * 400, prose(rng, 5), b"a" * 250 + b"b" + b"a" * 250, b"xyz" * 90, b"ab" * 200 + b"c" + b"ab" * 220]
    texts += [t[7:] for t in texts]
    ids = [None if i == 5 else i // 2 for i in range(len(texts))]
    whole = suffixdedup.Runs(texts, ids)
    assert whole.n.max() > 200
    n_windows = sum(max(0, len(t) - 49) for t, i in zip(texts, ids) if i is not None)
    assert whole.n.sum() == n_windows == len(set(whole.windows_of(np.arange(whole.n.size)).tolist()))
    by_bytes = {}
    for r in range(whole.n.size):
        by_bytes.setdefault(whole.text(r), set()).add((int(whole.m[r]), int(whole.hash[r])))
    assert all(len(x) == 1 for x in by_bytes.values())
    assert len(set.union(*by_bytes.values())) == len(by_bytes) == whole.lead.size
    monkeypatch.setattr(suffixdedup, "_STEP", 33)
    steps = suffixdedup.Runs(texts, ids)
    for name in ("start", "n", "m", "hash", "doc", "unique", "least"):
        assert (getattr(steps, name) == getattr(whole, name)).all(), name


def test_memory_of_a_block():
    rng = random.Random(9)
    texts = [prose(rng, 300) for _ in range(300)]
    suffixdedup.Runs(texts, list(range(300)))
    tracemalloc.start()
    suffixdedup.Runs(texts, list(range(300)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 32 * sum(map(len, texts))  # 19 times the text, 48 when each step made arrays of the whole block
