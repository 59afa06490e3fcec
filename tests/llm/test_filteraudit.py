import re
from itertools import permutations

import duckdb

from lectern.llm import filteraudit as FA
from lectern.llm.common import Scratch

SF = "/root/testdata/sf0.001"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_table_of_first_failures():
    table = FA.first_failures(5)
    assert table.shape == (32, 120)
    for mask in range(32):
        for k, order in enumerate(permutations(range(5))):
            assert table[mask, k] == next((s for s, f in enumerate(order) if mask >> f & 1), 5)


def brute(docs, labels):
    """Each order applied to each part's documents, filter by filter."""
    rows = []
    for d, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            bool(re.search(r"[#$%&*|]", text)), d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in docs),
        )
        rows.append((source or "", fails, any(i == d and q == 1 for i, q, _ in labels if i is not None), any(i == d and x == 1 for i, _, x in labels if i is not None)))
    out = []
    for part in {r[0] for r in rows}:
        mine, lost = [r for r in rows if r[0] == part], {}
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                gone, bad = [r for r in left if r[1][k]], [r for r in mine if r[1][k]]
                left = [r for r in left if not r[1][k]]
                lost[letter] = lost.get(letter, 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(bad) - len(gone), sum(sum(r[1]) == 1 for r in bad), sum(r[2] for r in gone), sum(r[3] for r in gone), letter])
        for o in out:
            if o[0] == part:
                o[-1] = lost[o[-1]]
    return sorted(map(tuple, out))


DOCS = [
    (5, "A b", "x"), (1, "A b", "x"), (1, "A b", "x"), (None, "A b", "x"), (7, None, None), (8, "", ""), (2, "w # " * 300, "y"), (3, " ".join(f"w{i}" for i in range(250)), "y"),
    (4, " ".join(f"w{i}" for i in range(250)), "y"), (6, "ÀB\x0bc\x1fd|", "z"), (9, " ".join(f"W{i}" for i in range(200)), "y"), (10, "a " * 100_000, "y"),
]
LABELS = [(5, 1, 0), (5, 0, 1), (1, 1, None), (4, 1, 1), (None, 1, 1), (99, 1, 1), (7, None, 1)]


def frames(spark):
    docs = spark.createDataFrame([(*d, 1, "m") for d in DOCS], "doc_id long, text string, source string, mask int, part string")
    labels = spark.createDataFrame([(*x, "s") for x in LABELS], "doc_id long, quality int, toxic int, source string")
    return docs, labels


def test_against_brute_force(spark, monkeypatch):
    docs, labels = frames(spark)
    want = brute(DOCS, LABELS)
    assert sorted(map(tuple, FA.report(docs, labels, Scratch(spark, "t")).select(COLUMNS).collect())) == want
    monkeypatch.setattr(FA, "PARTS", 1)  # arrays are sent on at every new part
    assert sorted(map(tuple, FA.report(docs.coalesce(1), labels, Scratch(spark, "t")).select(COLUMNS).collect())) == want


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert FA.report(docs.limit(0), labels, Scratch(spark, "t")).count() == 0
    out = FA.report(docs, labels.limit(0), Scratch(spark, "t"))
    assert out.count() == 4 * 600 and out.where("good_lost + toxic_lost > 0").count() == 0


def test_two_filters_and_no_labels(spark):
    df = spark.createDataFrame([("p", m) for m in (0, 1, 2, 3, 3)], "part string, mask int")
    out = {(r.filter_order, r.step): r for r in FA.audit(df, "XY", "part", "mask", [], Scratch(spark, "t")).collect()}
    assert (out["XY", 1].removed, out["XY", 2].removed, out["XY", 2].redundant, out["XY", 2].kept) == (3, 1, 2, 1)
    assert out["YX", 1].shapley == 4 and out["YX", 2].unique_fails == 1


def test_sql_says_the_same(spark):
    for t in ("documents", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = FA.report(docs, labels, Scratch(spark, "t")).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({FA.SQL})").fetchall())

