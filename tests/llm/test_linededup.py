from collections import Counter

import pytest

import __spark_entry__
from lectern.llm import linededup
from tests.test_oracle import SF, canon, duck  # noqa: F401


def brute(rows):
    order, gone = {}, Counter()
    for doc, text in sorted(((d, t) for d, t, *_ in rows if t is not None), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n")
        for i in range(len(lines) - 2):
            first = order.setdefault(tuple(lines[i : i + 3]), (doc, i))
            if first != (doc, i):
                gone.update({(doc, i + k): 1 for k in range(3)})
    return sorted((str(d), None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t, *_ in rows)


def test_brute_force(spark):
    rows = [(1, "a\nb\nc\nd", 9), (2, "x\na\nb\nc\ny", 9), (3, "a\nb\nc\na\nb\nc", 9), (4, None, 9), (5, "", 9), (6, "a\nb", 9), (6, "a\nb", 9), (None, "q\nr\ns", 9), (7, "q\nr\ns", 9), (8, "\n\n\n\n", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    out = linededup.dedup_lines(df)
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == brute(rows)
    assert {(r.doc_id, r.n_lines, r.n_removed) for r in out.where("doc_id IN (2, 4, 5)").collect()} == {(2, 5, 3), (4, 0, 0), (5, 1, 0)}


def test_clashing_columns(spark):
    names = ["places", "_covered", "covered", "n_removed", "row", "lines", "merged", "id", "of", "_id", "pos", "h1", "first", "kind"]
    rows = [(i, "a\nb\nc", *range(len(names))) for i in range(3)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, ["doc_id", "text", *names])).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in out) == [(0, "a\nb\nc", 0), (1, "", 3), (2, "", 3)]
    assert all(r[n] == k for r in out for k, n in enumerate(names) if n != "n_removed")


def test_a_text_of_many_repeated_lines(spark):
    """Lines times covered lines would be 10^10 here."""
    text = "\n".join(f"line {i}" for i in range(100_000))
    out = linededup.dedup_lines(spark.createDataFrame([(1, text), (2, text + "\nend")], "doc_id long, text string"))
    assert {(r.doc_id, r.n_lines, r.n_removed) for r in out.collect()} == {(1, 100_000, 0), (2, 100_001, 100_000)}


def test_empty(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", [n for n in sorted(__spark_entry__.oracle_sql()) if n.startswith("op") and n[2].isdigit()])
def test_sql(spark, duck, name):  # noqa: F811
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(__spark_entry__.oracle_sql()[name])
    want = sorted(tuple(canon(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall())
    assert sorted(rel.columns) == cols and got == want
