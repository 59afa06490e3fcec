import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern.sources import sqlite

ROWS = [(i, f"s{i % 4}" if i % 5 else None, i / 4, b"b" * (i % 3)) for i in range(100)]


def written(path, rows, table="t"):
    with sqlite3.connect(path) as db:
        db.execute(f'CREATE TABLE "{table}" (k INTEGER PRIMARY KEY, "a b" TEXT COLLATE NOCASE, x REAL, y BLOB, z)')
        db.executemany(f'INSERT INTO "{table}" VALUES (?, ?, ?, ?, NULL)', rows)
    return str(path)


def test_scan_equals_the_table(spark, tmp_path):
    df = sqlite.table(spark, written(tmp_path / "a.db", ROWS, "odd t"), "odd t", rows=7)
    assert df.schema.simpleString() == "struct<k:bigint,a b:string,x:double,y:binary,z:string>"
    assert df.rdd.getNumPartitions() == 15
    assert sorted((r.k, r["a b"], r.x, bytes(r.y), r.z) for r in df.collect()) == [(*r, None) for r in ROWS]


@pytest.mark.parametrize("where", ["k = 7", "k > 90 AND x <= 24", "`a b` = 's1'", "`a b` = 'S1'", "`a b` IN ('s2', 's3')", "`a b` IS NULL", "`a b` IS NOT NULL AND k < 10", "`a b` LIKE 's%'", "NOT k > 5", "z = 'q'", "k = 3 OR k = 4", "x = 1.25", "y = X'6262'", "k + 1 = 4"])
def test_filters(spark, tmp_path, where):
    df = sqlite.table(spark, written(tmp_path / "a.db", ROWS), "t", rows=30)
    plain = spark.createDataFrame([(*r, None) for r in ROWS], df.schema)
    assert sorted(df.where(where).select("k").collect()) == sorted(plain.where(where).select("k").collect())


def test_filters_reach_the_file(spark, tmp_path):
    reader = sqlite.SqliteReader("p", "t", [("k", "bigint"), ("s", "string")], 10)
    left = list(reader.pushFilters([sqlite.EqualTo(("k",), 3), sqlite.In(("s",), ("a", "b")), sqlite.IsNull(("s",)), sqlite.EqualTo(("k",), "3"), sqlite.EqualTo(("k", "x"), 3)]))
    assert len(left) == 2 and len(reader.where) == 3 and reader.values == [3, "a", "b"]


def test_values_of_other_types(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE t (k INT, s TEXT, d DECIMAL(9, 2))")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [("x", b"b", 1), (None, 5, "y"), (3, "t", 2.5)])
    df = sqlite.table(spark, str(tmp_path / "a.db"), "t")
    assert [tuple(r) for r in df.collect()] == [(None, None, 1.0), (None, "5", None), (3, "t", 2.5)]
    assert df.where("k IS NULL").count() == 2 and df.where("s = '5'").count() == 1 and df.where("d IS NOT NULL").count() == 2


def test_files_of_a_folder(spark, tmp_path):
    for k in range(3):
        written(tmp_path / f"{k}.sqlite", ROWS[k::3])
    (tmp_path / "note.txt").write_text("no")
    df = sqlite.table(spark, f"file:{tmp_path}", "t", rows=20)
    assert df.count() == 100 and df.agg(F.sum("k")).first()[0] == sum(range(100))


def test_read_only_and_odd_tables(spark, tmp_path):
    path = written(tmp_path / "a.db", [])
    with sqlite.connect(path) as db, pytest.raises(sqlite3.OperationalError):
        db.execute("DELETE FROM t")
    assert sqlite.table(spark, path, "t").count() == 0
    with pytest.raises(Exception, match="no table"):
        sqlite.table(spark, path, "none").count()
    with pytest.raises(Exception, match="no SQLite file|No such|FileNotFound"):
        sqlite.table(spark, str(tmp_path / "nothing"), "t").count()
    with sqlite3.connect(tmp_path / "w.db") as db:
        db.execute("CREATE TABLE t (k TEXT PRIMARY KEY, n INT) WITHOUT ROWID")
        db.execute("INSERT INTO t VALUES ('a', 1)")
    assert [tuple(r) for r in sqlite.table(spark, str(tmp_path / "w.db"), "t").collect()] == [("a", 1)]


def test_partitions_are_bounded(tmp_path, monkeypatch):
    """Small shares make no more partitions than a bound, with gaps in row numbers too, and lose no row."""
    import contextlib
    import sqlite3

    from lectern.sources import places, sqlite

    monkeypatch.setattr(places, "MOST_PARTS", 10, raising=False)
    for part in range(3):
        with contextlib.closing(sqlite3.connect(f"{tmp_path}/{part}.db")) as db:
            db.execute("CREATE TABLE t (k INTEGER PRIMARY KEY)")
            db.executemany("INSERT INTO t VALUES (?)", [(4 * k + part,) for k in range(500)])
            db.commit()
    reader = sqlite.SqliteReader(str(tmp_path), "t", [("k", "bigint")], 5)
    parts = reader.partitions()
    assert len(parts) <= 10 + 3
    assert sorted(r[0] for p in parts for r in reader.read(p)) == sorted(4 * k + part for k in range(500) for part in range(3))
