import gzip
import hashlib
import io
import json
import zipfile

import pytest

from lectern.functions import codecs
from lectern.sources import books, readers, sinks

RSS = '<rss xmlns:c="http://purl.org/rss/1.0/modules/content/"><channel><item><title>A</title><link>http://x/a</link><pubDate>Wed, 02 Oct 2024 13:00:00 GMT</pubDate><description>d</description><c:encoded>full</c:encoded></item><item><title>no link</title></item></channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>B</title><link href="http://x/b"/><updated>2024-10-02T13:00:00Z</updated></entry></feed>'


def test_feeds(spark):
    df = spark.createDataFrame([("r", RSS), ("a", ATOM), ("h", "<html></html>"), ("n", None), ("b", "<rss")], "src string, body string")
    out = {r.title: r for r in readers.feed_items(df, "body").collect()}
    assert set(out) == {"A", "B"}
    assert out["A"].id == hashlib.sha1(b"http://x/a").hexdigest() and out["A"].summary == "d" and str(out["B"].published) == "2024-10-02 13:00:00"
    assert readers.feed_items(df, "body", untitled=True).count() == 3


def test_feed_fields():
    body = """<rss><channel><item><title> A &lt;b&gt;bold&lt;/b&gt;  day </title><link href="http://x/1">http://y</link><link>http://x/2</link>
    <encoded>&lt;p&gt;Full &amp;amp; whole&lt;/p&gt;</encoded><description>&lt;i&gt;late&lt;/i&gt;</description></item>
    <item><title>B</title><link>http://x/b</link><description> &lt;br/&gt; </description></item></channel></rss>"""
    a, b = readers.parse_feed(body)
    assert (a["title"], a["url"], a["summary"], a["content"]) == ("A bold day", "http://x/1", "Full & whole", "Full & whole")
    assert (b["summary"], b["content"]) == (None, None)
    long = readers.parse_feed(f"<feed><entry><title>C</title><link href='u'/><summary>{'x' * 30_000}</summary></entry></feed>")[0]
    assert (len(long["summary"]), len(long["content"])) == (500, 20_000)


def test_broken_books():
    def book(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in ({"META-INF/container.xml": '<container><rootfile full-path="p.opf"/></container>'} | files).items():
                z.writestr(name, text)
        return out.getvalue()

    opf = lambda item: f'<package><manifest>{item}</manifest><spine><itemref idref="a"/></spine></package>'
    assert books.read_epub(book(**{"p.opf": opf('<item id="a"/>')}))["error"]
    assert books.read_epub(book(**{"p.opf": opf('<item id="a" href="a.html" properties="nav"/><item id="n" properties="nav"/>')}))["error"]
    assert books.read_epub(b"PK\x03\x04")["error"] and books.read_epub(b"")["error"]
    good = books.read_epub(book(**{"p.opf": opf('<item id="a" href="a.html"/>'), "a.html": "<p>x</p>"}))
    assert good["error"] is None and [p["html"] for p in good["parts"]] == ["<p>x</p>"]


def test_json_and_repairs(spark, tmp_path):
    with gzip.open(tmp_path / "d.jsonl.gz", "wt") as f:
        f.write('{"documentId": "1", "text": "t"}\n\n{"documentId": "2"}\n')
    assert readers.json_lines(spark, str(tmp_path / "d.jsonl.gz"), partitions=3).count() == 2
    logs = tmp_path / "logs"
    logs.mkdir()
    rows = [("applied", "news", "repair", "base", None), ("applied", "news", "delete", "rev", "tomb"), ("pending", "news", "repair", "p", None), ("applied", "other", "repair", "o", None)]
    for i, (state, index, op, old, new) in enumerate(rows):
        (logs / f"repair-{i}.json").write_text(json.dumps({"id": str(i), "createdAt": f"2024-01-0{i + 1}", "state": state, "index": index, "operation": op, "replacedDocumentId": old, "result": {"documentId": new}}, indent=1))
    (logs / "repair-bad.json").write_text("{")
    log = readers.repair_log(spark, str(logs))
    assert [r.id for r in log.collect()] == ["3", "2", "1", "0"]
    assert {r.doc_id for r in readers.excluded_ids(log, "news").collect()} == {"base", "rev", "tomb"}


def test_manifest(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps(x) for x in [{"url": "u", "wayback_status": "found", "wayback_timestamp": "1"}, {"url": "", "wayback_status": "found"}, {"url": "v"}]))
    rows, counts = readers.crawl_manifest(spark, str(tmp_path / "m.jsonl"))
    assert [r.section for r in rows.collect()] == ["unknown"] and tuple(counts.first()) == (1, 2)


def test_markdown(spark, tmp_path):
    (tmp_path / "1946").mkdir()
    (tmp_path / "1946" / "a b.md").write_text("# T\n1946-05-15 p2\nbody\n")
    (tmp_path / "1946" / "c.md").write_text("no")
    out = {r.path: r for r in readers.markdown_articles(spark, str(tmp_path), "news", r"(?s)^# (\S+)\n(\d{4}-\d{2}-\d{2}) p(\d*)\n(.*)$").collect()}
    assert (out["1946/a b.md"].logical_id, out["1946/a b.md"].page, out["1946/a b.md"].date) == ("news:1946/a b.md", 2, "1946-05-15")
    assert out["1946/c.md"].title is None


def test_files(spark, tmp_path):
    for p in ("1987/198701.pdf", "1987/198801.pdf", "1988/19880101.pdf", "1988/x.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    assert {tuple(r) for r in readers.issues(readers.files(spark, str(tmp_path), "*.pdf")).collect()} == {("1987", "198701"), ("1988", "19880101")}


def test_source_list(spark):
    ok = ("a", "A", "en", "/a", True)
    df = spark.createDataFrame([(1, *ok), (1, *ok), (2, "b", " ", "en", "b", None)], "version int, id string, name string, language string, route string, enabled boolean")
    assert {(r.code, r.id) for r in readers.source_list_errors(df).collect()} == {("duplicate", "a"), ("version", "b"), ("blank", "b"), ("route", "b")}


def test_masked_round_trip(spark, tmp_path):
    data, size, digest = sinks.masked_object({"a": "é"}, "x/1.json")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.json").write_bytes(data)
    row = readers.masked_json(spark, str(tmp_path), "a string").first()
    assert (row.path, row.value.a, size) == ("x/1.json", "é", 10)
    assert json.loads(gzip.decompress(codecs.mask(data, "x/1.json"))) == {"a": "é"}


def test_store_objects(spark, tmp_path):
    def put(name, content, root=str(tmp_path)):
        import os

        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(content)

    df = spark.createDataFrame([(b"a",), (b"a",), (b"b",), (None,)], "c binary")
    out = sinks.store_objects(df, "c", "html", "html", put, compress=True).collect()
    assert len(out) == 2 and all(hashlib.sha256(gzip.decompress((tmp_path / r.name).read_bytes())).hexdigest() == r.sha256 for r in out)


def test_bulk(spark):
    df = spark.range(1200).repartition(2)
    assert sinks.bulk(df, lambda rows: [] if len(rows) <= 500 else ["large"]).first().sent == 1200
    with pytest.raises(Exception, match="refused"):
        sinks.bulk(df, lambda rows: ["no"]).collect()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5), ("a|x", None)], "k string, v double")
    assert sinks.markdown_table(df, ["k", "v"], [df.k]).first().markdown == "| k | v |\n| --- | --- |\n| a\\|x | — |\n| b | 1.5 |"
    sinks.csv_report(df, str(tmp_path / "r"), ["k"])
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == ["k"]
    files = spark.createDataFrame([("1987", "b"), ("1987", "a"), ("1988", "c")], "year string, file string")
    assert json.loads(sinks.year_manifest(files).first().json)["years"][0] == {"year": "1988", "files": ["c"]}


def test_replace_scope(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.replace_scope(spark.createDataFrame([(1, "a"), (2, "b")], "x int, d string"), at, "d")
    sinks.replace_scope(spark.createDataFrame([(3, "a")], "x int, d string"), at, "d")
    assert {(r.x, r.d) for r in spark.read.parquet(at).collect()} == {(3, "a"), (2, "b")}


def test_stale(spark):
    r, e = spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("b",), ("c",)], "path string")
    assert {tuple(x) for x in sinks.stale_and_missing(r, e).collect()} == {("a", "stale"), ("c", "missing")}


def test_article_files_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from lectern.plans import files
    from lectern.registry import Registry

    monkeypatch.setattr(files, "shared_folder", lambda *_: str(tmp_path / "articles"))
    files.register(r := Registry())
    assert r.fns["articles_file_tree"](spark, "/root/testdata/sf0.001").count() == len(list((tmp_path / "articles").glob("k=*")))
    assert len({f.name[:10] for f in (tmp_path / "articles").glob("k=*/part-*.txt")}) > 1


def test_a_tree_is_listed_by_tasks(spark, tmp_path):
    tree = {"a.md": "# A\n1\n", "1946/05/15/deep/b c.md": "# B\n2\n", "1946/é+%41.md": "no", "x=1/_k=2/c.md": "# C\n3\n\n", "empty.md": "", "_s/d.md": "d", ".h/e.md": "e", "1946/_f.md": "f", "1946/g.MD": "g", "h.md.bak": "h"}
    for path, text in tree.items():
        (tmp_path / "in" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / path).write_text(text)
    (tmp_path / "in" / "1946" / "bytes.md").write_bytes(b"# \xff\n4\n")
    (tmp_path / "in" / "linked").symlink_to(tmp_path / "in" / "x=1")
    (tmp_path / "in" / "broken.md").symlink_to(tmp_path / "nowhere")
    (tmp_path / "none").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tree.link./in", f"file://{tmp_path}/in")
    pattern = r"(?s)^# (\S+)\n()()(.*)$"
    ours, theirs = (readers.markdown_articles(spark, root, "ns", pattern) for root in (f"file://{tmp_path}/in/", "viewfs://tree/in"))
    assert not ours.inputFiles() and theirs.inputFiles()
    assert {r.path for r in ours.collect()} == {"a.md", "1946/05/15/deep/b c.md", "1946/é+%41.md", "x=1/_k=2/c.md", "linked/_k=2/c.md", "1946/bytes.md"}
    assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))
    assert readers.markdown_articles(spark, f"{tmp_path}/none", "ns", pattern).isEmpty()
    assert {r.path for r in readers.markdown_articles(spark, f"{tmp_path}/in", "ns", pattern, "*.{MD,bak}").collect()} == {"1946/g.MD", "h.md.bak"}


def test_text_files(spark, tmp_path):
    rows = [("1", "a"), ("1", "a"), ("1", "b"), ("a/b: c=%é", "x\ny"), (None, "n"), ("", None), ("__HIVE_DEFAULT_PARTITION__", "m")]
    df = spark.createDataFrame(rows, "k string, value string").repartition(3)
    (tmp_path / "in").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.texts.link./in", f"file://{tmp_path}/in")
    sinks.text_files(df, f"file:{tmp_path}/ours", "k", "value")
    sinks.text_files(df, "viewfs://texts/in/theirs", "k", "value")
    found = [sorted((f.parent.name, f.name[:10], f.read_text()) for f in at.glob("k=*/part-*.txt")) for at in (tmp_path / "ours", tmp_path / "in" / "theirs")]
    assert len(found[0]) == len(rows) and [(k, text) for k, _, text in found[0]] == [(k, text) for k, _, text in found[1]]
    sinks.text_files(df.limit(0), f"{tmp_path}/none", "k", "value")
    assert [f.name for f in (tmp_path / "none").iterdir()] == ["_SUCCESS"]


def test_pages_of_one_id_are_files_of_their_own(spark, tmp_path):
    import __spark_entry__

    pages = spark.createDataFrame([(7, f"u{i // 2}") for i in range(100)] + [(8, "w")], "page_id long, url string")
    for name, df in (("some", pages), ("none", pages.limit(0))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}/pages.parquet")
    got = __spark_entry__.queries()["articles_file_tree"](spark, f"{tmp_path}/some")
    assert sorted((r.page_id, r.title, r.page, r.folder) for r in got.collect()) == sorted((7, f"u{i // 2}", 7, "ns:k=7") for i in range(100)) + [(8, "w", 0, "ns:k=8")]
    assert __spark_entry__.queries()["articles_file_tree"](spark, f"{tmp_path}/none").isEmpty()
