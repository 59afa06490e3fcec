import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import items
from lectern.sources import books
from tests.test_functions import one


def test_names_and_dates(spark):
    assert one(spark, text.chinese_date(F.col("v")), v="一九四六年五月廿一日") == "1946-05-21"
    assert one(spark, text.chinese_date(F.col("v")), v="1946年13月1日") is None
    assert one(spark, text.author_in_name(F.col("v")), v="Title (A. Writer) (Some Library)") == "A. Writer"
    assert one(spark, text.chosen_title(F.col("a"), F.col("b")), a="Works", b="Works vol. 2") == "Works vol. 2"
    assert len(one(spark, text.code_from_seed(F.col("v")), v="s")) == 8
    assert one(spark, text.canonical_url(F.col("v")), v="http://web.example/web/2020id_/http://x/y?a=1&amp;b") == "https://x/y?a=1&b"
    assert [tuple(r) for r in one(spark, text.image_widths(F.col("w"), F.col("h"), (488, 2000)), w=1000, h=666)] == [(488, 325)]
    assert one(spark, text.resolve_path(F.col("a"), F.col("b")), a="d/e.html", b="../f.png") == "f.png"
    assert one(spark, text.resolve_path(F.col("a"), F.col("b")), a="e.html", b="../f.png") is None
    assert one(spark, text.without_assets(F.col("v"), F.array(F.lit("x"))), v='a<figure data-asset="x">c</figure>b') == "ab"


def test_filters(spark):
    i = spark.createDataFrame([("a",), ("c",), ("b",), ("b",)], "issue string")
    assert [r.issue for r in items.between_issues(i, "issue", "b", None).collect()] == ["b", "c"]
    with pytest.raises(ValueError):
        items.between_issues(i, "issue", "c", "b")
    s = spark.createDataFrame([("x", None), ("y", "draft")], "id string, status string")
    assert [r.id for r in items.visible(s).collect()] == ["x"]
    assert one(spark, items.permitted_asset(F.col("v"), ["ex.org"]), v="https://a.ex.org/i.png")
    assert not one(spark, items.permitted_asset(F.col("v"), ["ex.org"]), v="https://aex.org/i.png")


def test_links(spark):
    links = spark.createDataFrame([("b", "f", "a"), ("b", "f", "z"), ("b", "g", ""), ("b", "f", ""), ("b", "", "")], "book string, file string, anchor string")
    out = items.resolve_links(links, links.where("file = 'f'"), links.where("anchor = 'a'"))
    assert sorted(r.state for r in out.collect()) == ["no_anchor", "no_file", "ok", "ok", "unreadable"]


def test_assets_and_overlays(spark):
    a = spark.createDataFrame([("1", "image"), ("2", "image"), ("3", "cover")], "asset_id string, role string")
    c = spark.createDataFrame([(["1"],)], "assetRefs array<string>")
    assert sorted(r.asset_id for r in items.used_assets(c, a).collect()) == ["1", "3"]
    new = spark.createDataFrame([("1", None)], "asset_id string, role string")
    assert {tuple(r) for r in items.replaced(a, new, "asset_id").collect()} == {("1", None), ("2", "image"), ("3", "cover")}
    assert {r.asset_id: r.action for r in items.stage(a, new, "asset_id").collect()} == {"1": "skipped", "2": "new", "3": "new"}


def test_quotas_and_names(spark):
    n = spark.createDataFrame([("animal", x) for x in ("a", "bb", "cccc", "dddd")] + [("plant", "a"), ("plant", "e")], "kind string, name string")
    chosen = items.quotas(n, "kind", "name", 3, 2, 1)
    assert chosen.where("kind = 'animal'").count() == 3 and chosen.where("name = 'a'").count() == 1
    assert {r.kind for r in items.shortages(chosen, "kind", 2, 1).collect()} == {"plant"}
    users = spark.range(50).withColumnRenamed("id", "user_id")
    out = items.unique_names(users, n, n.where("name = 'e'")).collect()
    assert len({r.name for r in out}) == 50 and "e" not in {r.name for r in out}


def test_merge_spine(spark):
    rows = [("b", i, i % 10 == 0, 100) for i in range(30)] + [("c", i, True, 100) for i in range(5)]
    out = items.merge_spine(spark.createDataFrame(rows, "book string, pos int, is_target boolean, chars int"), "book", "pos")
    assert {(r.book, r.part) for r in out.collect()} == {("b", 0), ("b", 10), ("b", 20)} | {("c", i) for i in range(5)}


def test_nth_note(spark):
    b = spark.createDataFrame([("g", 1, 1, 0), ("g", 2, None, 2), ("g", 3, 2, 1), ("g", 4, None, 1), ("g", 5, 1, 0), ("g", 6, None, 1)], "g string, ord int, level int, markers int")
    n = spark.createDataFrame([("g", 1, 2), ("g", 1, 3), ("g", 1, 4), ("g", 3, 1)], "g string, heading int, label int")
    assert {(r.heading, r.label): r.block for r in items.nth_note(n, b, "g").collect()} == {(1, 2): 2, (1, 3): 4, (1, 4): None, (3, 1): 4}


def test_epub(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns:dc="d"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator></metadata><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="c" href="c%201.xhtml"/></manifest><spine><itemref idref="c"/><itemref idref="none"/></spine></package>')
        z.writestr("O/nav.xhtml", '<html><a href="c%201.xhtml#x"> One </a></html>')
        z.writestr("O/c 1.xhtml", "<p>hi</p>")
    df = spark.createDataFrame([("ok", raw.getvalue()), ("bad", b"no"), ("null", None)], "path string, content binary")
    out = {r.path: r for r in books.epub_parts(df).collect()}
    assert (out["ok"].book_title, out["ok"].title, out["ok"].href, out["ok"].html) == ("T", "One", "O/c 1.xhtml", "<p>hi</p>")
    assert out["bad"].error == "BadZipFile" and out["bad"].pos is None
