import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.functions import readings as R

TABLE = [("重", "zhong", 1), ("重", "chong", 2), ("庆", "qing", 1), ("重庆", "chong qing", 1), ("的", "de", 1), ("史", "Shi", 1), ("长", "zhang", 2), ("长", "chang", 1)]


def test_longest_phrase_and_first_reading():
    trie = R.Readings([(p, r) for p, r, _ in sorted(TABLE, key=lambda t: t[2])])
    assert trie.read("重庆的史") == ["chong", "qing", "de", "shi"] and trie.read("a 1重x") == ["a 1", "zhong", "x"]
    assert trie.title_id("  重庆 （1949）Ａ长 ") == "chong-qing-1949-a-chang"
    assert trie.title_id("？！") == "book-" + hashlib.sha256("?!".encode()).hexdigest()[:12] and trie.title_id("未") == "book-" + hashlib.sha256("未".encode()).hexdigest()[:12]


def test_long_ids():
    trie = R.Readings([("重", "zhong")])
    title = "重" * 14
    assert len(trie.title_id("重" * 13)) == 77
    assert trie.title_id(title) == "-".join(["zhong"] * 12)[:71].rstrip("-") + "-" + hashlib.sha256(title.encode()).hexdigest()[:8] and len(trie.title_id("x" * 200)) == 80
    assert len(trie.title_id("x" * 80)) == 80


def test_column(spark, monkeypatch):
    table = spark.createDataFrame([*TABLE, ("", "x", 1), ("空", " ", 1), (None, "x", 1)], "phrase string, reading string, rank int")
    rows = spark.createDataFrame([(1, "重庆"), (2, None), (3, "")], "k int, title string")
    assert {r.k: r.i for r in rows.select("k", R.title_ids(table)(F.col("title")).alias("i")).collect()} == {1: "chong-qing", 2: None, 3: "book-" + hashlib.sha256(b"").hexdigest()[:12]}
    monkeypatch.setattr(R, "MOST_READINGS", 3)
    with pytest.raises(ValueError):
        R.title_ids(table)
