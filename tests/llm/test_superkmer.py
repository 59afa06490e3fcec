import hashlib
import random
from collections import Counter

import pytest

from lectern.llm import superkmer
from lectern.llm.common import Scratch


def brute(rows, width=35):
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + width]) for _, w in docs for i in range(len(w) - width + 1))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "é", "日本"] + [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "of " * 200), (3, "a b " * 40), (4, "x y z"), (4, "x y z"), (None, " ".join(passage))]
    for i in range(10, 60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))]
        if i % 2:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[rng.randrange(20) :]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return [*rows, (99, rows[20][1]), (99, rows[20][1])]


@pytest.mark.parametrize("hot", [2_048, 1])
def test_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(superkmer, "HOT", hot)
    rows = rows_of(5)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string").repartition(5)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in superkmer.digests(df, Scratch(spark, "t")).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert superkmer.digests(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark, "t")).count() == 0
