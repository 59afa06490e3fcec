import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import export
from lectern.sources import bookfiles as BF
from lectern.sources import books, readers

SCHEMA = "book string, title string, authors array<string>, language string, pos int, chapter_id string, chapter string, body string"
WHEN = "2024-01-01T00:00:00Z"


def shelf(spark, n=5, parts=4):
    return spark.createDataFrame([(f"b{i}", f"B & {i}", ["X", "Y"], "en", k, f"c{k}", f"C <{k}>", f"<p>{i}.{k}</p>") for i in range(n) for k in reversed(range(parts))], SCHEMA)


def opened(spark, at):
    return books.epub_parts(spark.read.format("binaryFile").load(f"{at}/*.epub").select("content"))


def test_written_and_read_back(spark, tmp_path):
    BF.write_books(shelf(spark), str(tmp_path), "epub", WHEN)
    got = opened(spark, tmp_path).orderBy("book_title", "pos").collect()
    assert [(r.book_title, r.authors, r.title, r.html.split("</h1>")[1]) for r in got] == [(f"B & {i}", ["X", "Y"], f"C <{k}>", f"<p>{i}.{k}</p></body></html>") for i in range(5) for k in range(4)]
    assert json.loads((tmp_path / "_SUCCESS").read_text()) == {"books": 5, "chapters": 20} and not any((tmp_path / "_staged").iterdir())
    with zipfile.ZipFile(tmp_path / "b0.epub") as z:
        first = z.infolist()[0]
        assert (first.filename, first.compress_type, z.read(first)) == ("mimetype", zipfile.ZIP_STORED, b"application/epub+zip")


def test_equal_rows_give_equal_files(spark, tmp_path):
    for k in (1, 3):
        BF.write_books(shelf(spark).repartition(k), str(tmp_path / str(k)), "epub", WHEN)
    assert all((tmp_path / "1" / f"b{i}.epub").read_bytes() == (tmp_path / "3" / f"b{i}.epub").read_bytes() for i in range(5))


def test_append_and_overwrite(spark, tmp_path):
    BF.write_books(shelf(spark, 2), str(tmp_path), "markdown", WHEN)
    BF.write_books(shelf(spark, 3).where("book = 'b2'"), str(tmp_path), "markdown", WHEN)
    assert sorted(p.name for p in tmp_path.glob("*.md")) == ["b0.md", "b1.md", "b2.md"]
    BF.write_books(shelf(spark, 1), str(tmp_path), "markdown", WHEN, mode="overwrite")
    assert [p.name for p in tmp_path.glob("*.md")] == ["b0.md"]


def test_failed_job_leaves_nothing(spark, tmp_path):
    @F.udf("string")
    def fail(x):
        if x == "<p>3.2</p>":
            raise RuntimeError("task lost")
        return x

    BF.write_books(shelf(spark, 1), str(tmp_path), "epub", WHEN)
    before = {p.name: p.read_bytes() for p in tmp_path.glob("*.epub")}
    with pytest.raises(Exception, match="task lost"):
        BF.write_books(shelf(spark).withColumn("body", fail("body")), str(tmp_path), "epub", WHEN)
    assert {p.name: p.read_bytes() for p in tmp_path.glob("*.epub")} == before and not any((tmp_path / "_staged").iterdir())


def test_rows_must_be_together_and_in_order(spark, tmp_path):
    spark.dataSource.register(BF.Books)
    rows = shelf(spark, 2).select(*[(F.col(c) if c in SCHEMA else F.lit(None)).cast(t).alias(c) for c, t in BF.COLUMNS.items()])
    for df, why in ((rows.coalesce(1).orderBy("pos", "book").coalesce(1), "together"), (rows.coalesce(1), "order"), (rows.sortWithinPartitions("book", "pos").repartition(3), "two tasks|order|together")):
        with pytest.raises(Exception, match=why):
            df.write.format("books").mode("append").option("kind", "epub").save(str(tmp_path))
    assert not list(tmp_path.glob("*.epub"))
    with pytest.raises(Exception, match="kind must be one of"):
        BF.write_books(shelf(spark), str(tmp_path), "pdf")


def test_file_names():
    names = [BF.file_name(x) for x in ("a:1", "a-1", "a/1", "../x", "", "_x", "é" * 300)]
    assert len(set(names)) == 7 and names[1] == "a-1" and not any("/" in n or n.startswith((".", "_")) for n in names)


def test_files_of_a_book(spark, tmp_path):
    """Files come before chapters, each once; toc entries may point into a chapter; broken archives are rows."""
    chapters = spark.createDataFrame([("b", "T", ["A"], "en", 0, "c0", "One", '<figure data-asset-id="i" data-width="40"><figcaption>Cap</figcaption></figure><span data-asset-id="j" class="x"></span><span data-asset-id="none"></span>', [("One", None), ("Deep", "d1")])], SCHEMA + ", toc array<struct<title:string,anchor:string>>")
    assets = spark.createDataFrame([("b", "i", "assets/i.png", "image", "image/png", 'A "q"', b"1"), ("b", "j", "assets/j.png", "image", "image/png", None, b"2"), ("b", "k", "assets/i.png", "image", "image/png", None, b"1"), ("b", "f", "f.woff", "font", "font/woff", None, b"")], "book string, id string, path string, type string, media_type string, alt string, data binary")
    notes = spark.createDataFrame([], "book string, target_id string, pos int, id string, label string, body string")
    BF.write_books(export.catalogue_books(chapters, assets, notes), str(tmp_path), "epub", WHEN)
    (tmp_path / "broken.epub").write_bytes(b"PK no")
    rows = readers.archive_entries(spark.read.format("binaryFile").load(f"{tmp_path}/*.epub").select("path", "content")).collect()
    entries = {r.name: bytes(r.data) for r in rows if r.name}
    assert [r.error for r in rows if r.name is None] == ["BadZipFile"]
    assert entries["OEBPS/assets/i.png"] == b"1" and "OEBPS/f.woff" not in entries
    html, nav = entries["OEBPS/chapters/chapter-0001.xhtml"].decode(), entries["OEBPS/nav.xhtml"].decode()
    assert '<figure data-width="40"><img src="../assets/i.png" alt="A &quot;q&quot;"/><figcaption>Cap</figcaption></figure><img class="inline-image" src="../assets/j.png" alt=""/><span data-asset-id="none"></span>' in html
    assert '<li><a href="chapters/chapter-0001.xhtml#d1">Deep</a></li>' in nav


def test_projects(spark, tmp_path):
    blocks = spark.createDataFrame([("p", 1, "text", 0, " lead\t in "), ("p", 2, "page_number", 0, "7"), ("p", 3, "heading", 1, "H1"), ("p", 4, "text", 2, "H2"), ("p", 5, "text", 1, "x" * 91), ("p", 6, "heading", 1, "y" * 60), ("p", 7, "heading", 1, "z" * 60)], "book string, order int, type string, level int, text string")
    projects = spark.createDataFrame([("p", "P", ["A"], "en", None), ("q", "Empty", [], "en", None)], "book string, title string, authors array<string>, language string, subtitle string")
    rows = export.project_books(blocks, projects, "markdown").orderBy("book", "pos").collect()
    assert [(r.chapter_id, r.chapter, r.body) for r in rows] == [
        ("chapter-001", "lead in", ""), ("chapter-002", "H1 - H2", "### H1\n\nH2\n\n" + "x" * 91), ("chapter-003", "y" * 60 + " - " + "z" * 32 + "…", f"### {'y' * 60}\n\n### {'z' * 60}"), ("chapter-001", "Empty", ""),
    ]
    BF.write_books(export.project_books(blocks, projects, "markdown"), str(tmp_path), "markdown", WHEN)
    assert (tmp_path / "q.md").read_text() == "# Empty\n\n## Empty\n"
