import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from lectern.llm import decontam


def sellers(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (p != c))
        best = min(best, row[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abcd", max_size=30))
def test_distance(pattern, text):
    assert decontam.distance(pattern, text)[0] == sellers(pattern, text)


def test_recall_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "a"] * 60
    word = lambda: rng.choice(vocabulary)
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 13, 16, 25, 40])))) for i in range(30)]
    docs = []
    for i in range(200):
        words = [word() for _ in range(rng.randrange(0, 120))]
        if i % 2:
            part = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 1 + len(part) // 8)):
                k = rng.randrange(len(part))
                rng.choice([lambda: part.pop(k), lambda: part.insert(k, word()), lambda: part.__setitem__(k, word())])()
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((i, rng.choice([" ", "\n"]).join(words).replace("w1", "W1"), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, items[0][1], "x"), (902, items[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find(df, bench).collect()}
    norm = lambda t: " ".join((t or "").lower().split())
    want = {(d, i) for d, t, _ in docs for i, p in items if t and sellers(p, norm(t)) <= decontam.MAX_EDITS * len(p)}
    assert got <= want
    assert len(got & want) >= 0.9 * len(want)


def test_planted_whole_items(spark):
    sf = "/root/testdata/sf0.01"
    want = set(duckdb.sql(f"SELECT d.doc_id, b.item_id FROM '{sf}/documents.parquet' d, '{sf}/benchmark.parquet' b WHERE contains(d.text, b.text)").fetchall())
    got = {(r.doc_id, r.item_id) for r in __spark_entry__.queries()["op4_decontamination"](spark, sf).collect()}
    assert want <= got and len(got) <= len(want) + 5


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find(docs, items).count() == 0
    assert decontam.find(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def spread_evenly(text, share, rng):
    out, n = list(text), len(text)
    k = int(n * share)
    begin = rng.random() * n / max(k, 1)
    for j in range(k):
        at = int(begin + j * n / k)
        if at < n:
            out[at] = rng.choice([c for c in "abcdefghijklmnop" if c != out[at]])
    return "".join(out)


def anywhere(text, share, rng):
    out = list(text)
    for _ in range(int(len(text) * share)):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.pop(at), lambda: out.insert(at, rng.choice("abcdefghijklmnop ")), lambda: out.__setitem__(at, rng.choice("abcdefghijklmnop"))])()
    return "".join(out)


def whole_words(text, share, rng):
    out = text.split()
    for at in sorted(rng.sample(range(len(out)), int(len(out) * share)), reverse=True):
        rng.choice([lambda: out.pop(at), lambda: out.insert(at, "other"), lambda: out.__setitem__(at, "other")])()
    return " ".join(out)


@pytest.mark.parametrize("edit, shares", [(spread_evenly, (0.0, 0.03, 0.05, 0.08, 0.1)), (anywhere, (0.05, 0.1, 0.15, 0.2)), (whole_words, (0.05, 0.1, 0.2))])
def test_recall_by_length_and_edits(edit, shares):
    """At least 0.9 of the true hits, by the items' words and the share of edits; real words of the benchmark table."""
    rng = random.Random(5)
    given_items = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/benchmark.parquet' ORDER BY item_id").fetchall()]
    others = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE length(text) > 400 ORDER BY doc_id LIMIT 40").fetchall()]
    words = " ".join(given_items).lower().split()
    for n in (15, 20, 40, 59, 80):
        items = [(i, " ".join(words[at : at + n])) for i in range(60) for at in [rng.randrange(len(words) - n)]]
        index = decontam.Index(items)
        for share in shares:
            texts, want = [], set()
            for d, (_, item) in enumerate(items):
                part = edit(item, share, rng)
                texts.append(f"{rng.choice(others)[:300]} {part} {rng.choice(others)[:300]}".encode())
                if decontam.distance(item, " ".join(part.split()))[0] <= decontam.MAX_EDITS * len(item):
                    want.add((d, d))
            got = {(d, i) for d, i, *_ in decontam._hits(texts, index)}
            assert len(want) >= 40 and len(want & got) >= 0.9 * len(want), (n, share, len(want & got), len(want))


def test_expected_recall():
    assert decontam.expected_recall(decontam.TARGET_WORDS, decontam.MAX_EDITS) > 0.95 > decontam.expected_recall(decontam.TARGET_WORDS - 1, decontam.MAX_EDITS)


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEM_BYTES", 60)
    items = [(i, f"item number {i} has these words {i * 7} and those {i * 11}") for i in range(7)]
    docs = spark.createDataFrame([(i, f"before {t} behind") for i, t in items], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find(docs, spark.createDataFrame(items, "item_id long, text string")).where("distance = 0").collect()}
    assert got == {(i, i) for i in range(7)}


def test_item_without_its_first_words_opens_a_slice():
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa"
    index = decontam.Index([(1, item)])
    for cut in (1, 2):
        part = " ".join(item.split()[cut:]).encode()
        rows = [list(decontam._hits([*before, part], index)) for before in ([], [b"some words"])]
        assert [r[1:] for r in rows[0]] == [r[1:] for r in rows[1]] and len(rows[0]) == 1
