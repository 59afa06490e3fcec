import math

import duckdb
import numpy as np
import pytest

from lectern.llm import embdedup
from lectern.llm.common import Scratch


def brute(rows, threshold=0.98):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.asarray(v, np.float64)
        return x / np.linalg.norm(x)

    units, root = [unit(v) for _, v, _ in rows], list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, _, a) in enumerate(rows):
        for j in range(i):
            x, y = units[i], units[j]
            if a is not None and a == rows[j][2] and x is not None and y is not None and len(x) == len(y) and x @ y >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    least = [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))]
    return sorted((str(r[0]), links[i], str(least[i])) for i, r in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, kept int").repartition(3)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embdedup.dedup(df, Scratch(spark, "t")).collect())


@pytest.mark.parametrize("per_cell", [4_000, 15])
def test_brute_force(spark, monkeypatch, per_cell):
    monkeypatch.setattr(embdedup, "PER_CELL", per_cell)
    monkeypatch.setattr(embdedup, "ROWS", 40)
    rng = np.random.Generator(np.random.PCG64(4))
    base = rng.normal(size=(30, 8))
    rows = [(i, [float(np.float32(x)) for x in base[i % 30] + rng.normal(size=8) * 0.1], int(i % 2)) for i in range(240)]
    rows += [(500 + i, rows[3][1], rows[3][2]) for i in range(50)]
    nan = float("nan")
    rows += [(700, None, 0), (701, [0.0] * 8, 0), (702, [nan] * 8, 0), (703, [None, 1.0], 0), (704, [1.0, 0.0], 0), (705, [2.0, 0.0], 0), (706, rows[3][1], None), (None, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (707, [], 0)]
    assert run(spark, rows) == brute(rows)


def test_several_cells_at_the_tested_sizes():
    assert embdedup.cells_for(500, 500) == 8 and embdedup.cells_for(2_000, 2_000) == 8 and embdedup.cells_for(51_000, 20_000) == 12
    assert embdedup.cells_for(3, 3) == 1 and embdedup.cells_for(10**9, 20_000) == embdedup.MAX_CELLS


def test_several_lengths(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    rows = []
    for dim, n in ((5, 80), (9, 60), (3, 40)):
        base = rng.normal(size=(8, dim))
        rows += [(len(rows) + i, [float(np.float32(x)) for x in base[i % 8] + rng.normal(size=dim) * 0.05], int(i % 2)) for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_lengths_beyond_the_commonest(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "MAX_DIMS", 1)
    test_several_lengths(spark)


def test_given_table(spark):
    rows = duckdb.sql("SELECT vec_id, embedding, label FROM '/root/testdata/sf0.01/embeddings.parquet'").fetchall()
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
