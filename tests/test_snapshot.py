import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.operators import validation
from lectern.sources import places, snapshot


def files(at):
    return {p: p.stat().st_mtime_ns for kind in ("parts", "catalogue") for p in Path(at, kind).rglob("*.parquet")}


def states(report):
    return {r.part: r.state for r in report.collect()}


def test_only_what_changed_is_written(spark, tmp_path):
    at = str(tmp_path / "s")
    rows = spark.createDataFrame([(f"d{i % 4}", i, "x" * i) for i in range(40)] + [(None, 1, None)], "dataset string, k int, body string")
    assert states(snapshot.refresh(rows, at, "dataset")) == {**{f"d{i}": "written" for i in range(4)}, None: "written"}
    assert sorted(snapshot.current(spark, at, "dataset").select("dataset", "k", "body").collect(), key=str) == sorted(rows.collect(), key=str)
    before = files(at)
    # the same rows in another order and number of partitions: nothing is written
    assert set(states(snapshot.refresh(rows.repartition(7), at, "dataset")).values()) == {"kept"} and files(at) == before
    one = rows.withColumn("body", F.when(F.col("k") == 5, "changed").otherwise(F.col("body")))
    assert states(snapshot.refresh(one, at, "dataset")) == {"d0": "kept", "d1": "written", "d2": "kept", "d3": "kept", None: "kept"}
    new = [p for p in files(at) if p not in before and "parts" in p.parts]
    assert new and all("dataset=d1" in str(p) for p in new)
    assert sorted(snapshot.current(spark, at, "dataset").select("dataset", "k", "body").collect(), key=str) == sorted(one.collect(), key=str)
    less = one.where("dataset <> 'd2'")
    assert states(snapshot.refresh(less, at, "dataset")) == {"d0": "kept", "d1": "kept", "d2": "removed", "d3": "kept", None: "removed"}
    assert snapshot.current(spark, at, "dataset").count() == less.count()
    assert set(states(snapshot.refresh(less.limit(0), at, "dataset")).values()) == {"removed"} and snapshot.current(spark, at, "dataset").count() == 0


def test_repeated_rows_and_nulls_count(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("b", 1, None), ("c", None, "1")], "p string, k int, s string")
    prints = {r.part: r.fingerprint for r in snapshot.fingerprints(rows, "p").collect()}
    assert len(set(prints.values())) == 3


def test_failure_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "s")
    rows = spark.createDataFrame([("a", 1)], "p string, k int")
    snapshot.refresh(rows, at, "p")
    monkeypatch.setattr(places, "put", lambda *a: (_ for _ in ()).throw(OSError("no room")))
    with pytest.raises(OSError):
        snapshot.refresh(rows.withColumn("k", F.lit(2)), at, "p")
    assert [r.k for r in snapshot.current(spark, at, "p").collect()] == [1]


def test_collection_documents(spark):
    datasets = spark.createDataFrame([("id-000001", "A | B", "book", "zh", None), ("id-000002", "A | B", "book", "zh", "x")], "dataset string, title string, type string, language string, description string")
    items = spark.createDataFrame([("id-000001", "v1", "i1", "One", "book", 1, ["X", "Y"], None, 2, 0), ("id-000001", "v2", "i2", "Two", "book", 0, [], "P", 0, 0)], "dataset string, item_key string, item_id string, title string, type string, `order` int, authors array<string>, publisher string, assets int, annotations int")
    chapters = spark.createDataFrame([("id-000001", "v1", "c2", 2, "Second"), ("id-000001", "v1", "c1", 1, "First")], "dataset string, item_key string, id string, `order` int, title string")
    out = {r.path: r.content for r in snapshot.collection_documents(datasets, items, chapters).collect()}
    assert set(out) == {"collections/A-B/README.md", "collections/A-B-000002/README.md", *(f"collections/A-B/items/v{k}.{e}" for k in (1, 2) for e in ("md", "toc.json"))}
    toc = json.loads(out["collections/A-B/items/v1.toc.json"])
    assert toc["chapterCount"] == 2 and [c["id"] for c in toc["chapters"]] == ["c1", "c2"] and toc["datasetTitle"] == "A | B"
    assert "- 作者：X、Y\n- 出版社：未注明\n- 章节数：2" in out["collections/A-B/items/v1.md"] and out["collections/A-B/items/v1.md"].endswith("- First\n- Second\n")
    table = out["collections/A-B/README.md"]
    assert table.index("| Two | 0 |") < table.index("| One | 2 |") and "# A \\| B" in table and "- 卷册/Item：2" in table
    assert "- 卷册/Item：0" in out["collections/A-B-000002/README.md"]


def release(spark):
    body = lambda t: (len(t), __import__("hashlib").sha256(t).hexdigest(), t)
    datasets = spark.createDataFrame([("d", "d", "d.x"), ("e", "other", "e.x")], "dataset string, index_dataset string, object string")
    items = spark.createDataFrame([("d", "i", "i", "i.m", True), ("d", "j", "k", "j.m", None)], "dataset string, item_id string, manifest_item string, object string, in_report boolean")
    fragments = spark.createDataFrame(
        [("c1", "chapter", "i", "i", "1", "1", *body(b"one"), None), ("c2", "chapter", "i", "i", "2", "9", 1, "00", b"two", None), ("s", "search", "i", "i", None, None, *body(b""), "1"), ("t", "search", "i", "i", None, None, 0, body(b"")[1], None, "3")],
        "object string, kind string, item_id string, manifest_item string, chapter_id string, fragment_id string, size long, sha256 string, content binary, toc_target string",
    )
    documents = spark.createDataFrame([("i.m", "c1"), ("i.m", "c9"), (None, "c1"), ("z.m", "z")], "manifest_object string, fragment_object string")
    return datasets, items, fragments, documents


WRONG = [
    ("dataset", "e.x", "dataset id differs"), ("document", None, "manifest does not exist"), ("document", "i.m", "fragment does not exist"), ("document", "z.m", "fragment does not exist"), ("document", "z.m", "manifest does not exist"),
    ("fragment", "c2", "digest differs"), ("fragment", "c2", "identity differs"), ("fragment", "c2", "size differs"), ("fragment", "t", "target does not exist"), ("item", "j.m", "item id differs"), ("item", "j.m", "item is not in the report"),
]


def test_validation(spark, tmp_path):
    rows = validation.checked(*release(spark))
    told = validation.validate(rows, str(tmp_path / "e"), {"datasets": 2, "items": 2, "chapters": 5, "searchDocuments": 4})
    assert told.counts == {"dataset": 2, "item": 2, "fragment": 4, "document": 4}
    assert told.errors == 12 and told.first[-1] == "chapters differ from the report" and len(told.first) == 12
    got = spark.read.parquet(str(tmp_path / "e")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(WRONG, key=str)


def test_validation_is_one_job(spark, tmp_path):
    rows = validation.checked(*(t.limit(0) for t in release(spark)))
    told = validation.validate(rows, str(tmp_path / "e"), {"datasets": 0, "items": 0, "chapters": 0, "searchDocuments": 0})
    assert told == validation.Summary({"dataset": 0, "item": 0, "fragment": 0, "document": 0}, 0, [])
