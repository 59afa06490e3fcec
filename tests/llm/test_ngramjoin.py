import random
import re

import numpy as np
import pytest

from lectern.llm import ngramjoin
from lectern.llm.common import Scratch
from lectern.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=85):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted((str(d), len(sets[i]), str(min((x for x in groups[find(i)] if x is not None), default=None))) for i, (d, _) in enumerate(rows))


def rows_of(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(300)] + ["the", "of"] * 40
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a b c"), (4, "A b C"), (5, "a b"), (6, "x " * 50), (None, "q r s t u v"), (7, "q r s t u V")]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([5, 8, 30, 120]))] for _ in range(12)]
    for i in range(10, 130):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return [*rows, (200, rows[15][1]), (200, rows[15][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, component_id int").repartition(4)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngramjoin.result(df, Scratch(spark, "t")).collect())
    assert got == brute(rows)


def near_copies(n, words, edits, seed=3):
    """Copies of one text that differ in a few words each, so that most pairs are candidates and few or many link."""
    rng, base = random.Random(seed), [f"v{i}" for i in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for k in rng.sample(range(words), rng.choice(edits)):
            text[k] = f"e{i}.{k}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("edits", [[1, 2, 3], [3, 4]])
def test_a_large_group_is_cut_into_blocks(spark, monkeypatch, edits):
    monkeypatch.setattr(ngramjoin, "ROWS", 8)
    monkeypatch.setattr(ngramjoin, "_STEP", 50)
    rows = near_copies(90, 120, edits)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngramjoin.result(df, Scratch(spark, "t")).collect())
    assert got == brute(rows)


def test_block_numbers_of_late_partitions(spark):
    """Blocks are numbered by partition; those of partition 2,048 and later must not clash or overflow."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.range(2_200).selectExpr("id AS doc_id", f"concat('{text}', ' x', CAST(id DIV 2190 AS STRING), ' ', CAST(id AS STRING)) AS text").where("doc_id % 500 = 0 OR doc_id > 2190")
    got = ngramjoin.result(rows.repartitionByRange(2_200, "doc_id"), Scratch(spark, "t")).collect()
    assert {r.component_id for r in got if r.doc_id < 2190} == {0} and {r.component_id for r in got if r.doc_id > 2190} == {0}


def test_prefix_order_is_by_the_whole_hash():
    doc, df, h = np.zeros(4, np.int32), np.array([2, 2, 2, 1], np.uint32), np.array([5, 3, 4, 9], np.uint64)
    assert ngramjoin._by_frequency(doc, df, h).tolist() == [3, 1, 2, 0]


def test_sketches_differ_by_at_most_the_symmetric_difference():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 3, 40, 90]))).encode() for _ in range(30)]
    sets = ngramjoin.Sets(texts, 2)
    held = [set(sets.h[a:b].tolist()) for a, b in zip(sets.at, sets.at[1:])]
    assert [len(x) for x in held] == sets.sizes.tolist() == [len(shingles(t.decode(), 2)) for t in texts]
    sketch = sets.sketches(np.arange(30))
    for i in range(30):
        for j in range(30):
            assert ngramjoin._differ(sketch[[i]], sketch[[j]])[0] <= len(held[i] ^ held[j])


def test_a_long_text(spark):
    """A text far over a block is a block of its own."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(50_000)}" for _ in range(600_000)]
    copy = list(words)
    copy[1000] = "other"
    rows = [(3, " ".join(words)), (2, " ".join(copy)), (1, " ".join(words[:300_000]))]
    got = ngramjoin.result(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(3, 2), (2, 2), (1, 1)}


def test_empty(spark):
    assert ngramjoin.result(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark, "t")).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(60, 61), (61, 60), (70, 70)], "a long, b long")
    got = {r.node: r.root for r in components(links, Scratch(spark, "t"), "c").collect()}
    assert got == {i: 0 for i in range(51)} | {60: 60, 61: 60}


def test_documents_behind_many_empty_rows_link(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty alpha bravo charlie delta"
    full = spark.createDataFrame([(2_000_001, text), (2_000_002, text + " echo")], "doc_id long, text string")
    df = spark.range(0, 1_100_000, 1, 1).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text").union(full).coalesce(1)
    got = ngramjoin.result(df, Scratch(spark, "t"))
    assert {(r.doc_id, r.component_id) for r in got.where("n_shingles > 0").collect()} == {(2_000_001, 2_000_001), (2_000_002, 2_000_001)}
    assert got.count() == 1_100_002
