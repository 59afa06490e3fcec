"""Small cases with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.functions import titles
from lectern.operators import blocks, calendar, content, crawl, feeds, flags, reader, search

RULE = "struct<id: string, name: string, conditionType: string, serve: boolean, percentage: int, bucketSalt: string, startsAt: timestamp, endsAt: timestamp, enabled: boolean, isFallback: boolean, userIds: array<string>>"


def rule(i, kind, serve, percentage=None, users=None, fallback=False, enabled=True, name="n"):
    return (i, name, kind, serve, percentage, "s", None, None, enabled, fallback, users)


def test_newer_version_beats_score_and_tombstone_hides(spark):
    hit = "logical_id string, version int, score double, seq int"
    base = spark.createDataFrame([("a", 1, 10.0, 0), ("b", 1, 5.0, 1), (None, 1, 1.0, 2), (None, 1, 1.0, 3)], hit)
    delta = spark.createDataFrame([("a", 2, 2.0, 0)], hit)
    state = search.latest_state(spark.createDataFrame([("a", 2, True, 0), ("a", 2, False, 1), ("b", 2, True, 2)], "logical_id string, version int, deleted boolean, seq int"))
    got = sorted((r.logical_id or "", r.version) for r in search.overlay_merge(base, delta, state).collect())
    assert got == [("", 1), ("", 1), ("a", 2)]


def test_pages_and_cursors(spark):
    df = spark.createDataFrame([(1, f"id{i}") for i in (1, 2, 3)], "at int, id string")
    assert [r.id for r in reader.keyset_page(df, ["at", "id"], None, 2).collect()] == ["id3", "id2"]
    assert [r.id for r in reader.keyset_page(df, ["at", "id"], (1, "id2"), 2).collect()] == ["id1"]
    with pytest.raises(ValueError):
        reader.keyset_page(df, ["at", "id"], (1, None), 2)
    with pytest.raises(ValueError):
        search.page(df, [F.asc("id")], 0, 10)


def test_keyword_condition(spark):
    df = spark.createDataFrame([("red apple",), ("green apple",), ("red car",), (None,)], "t string")
    hits = lambda q: [r.t for r in df.where(search.keyword_condition(q, F.col("t"))).collect()]
    assert hits("apple AND NOT green") == ["red apple"]
    assert hits("“red car” or green") == ["green apple", "red car"]
    assert hits("(red OR green) and apple") == ["red apple", "green apple"]
    assert search.is_quoted_only('"a b"') and not search.is_quoted_only('"a" b')


def test_flags(spark):
    given = spark.createDataFrame([("f", 1, [rule("r1", "users", True, users=["u"]), rule("r2", "global", False, fallback=True)])], f"key string, revision bigint, rules array<{RULE}>")
    users = spark.createDataFrame([("u",), ("v",), (None,)], "user_id string")
    got = {r.user_id: (r.enabled, r.rule_id) for r in flags.evaluate(given, users, F.current_timestamp()).collect()}
    assert got == {"u": (True, "r1"), "v": (False, "r2"), None: (False, "r2")}
    bad = spark.createDataFrame([("g", 1, [rule("r1", "percentage", True, percentage=0), rule("r1", "global", False, fallback=True)]), ("h", 1, [])], f"key string, revision bigint, rules array<{RULE}>")
    assert {(r.key, r.code) for r in flags.rule_errors(bad).collect()} >= {("g", "percentage"), ("g", "duplicate_id"), ("h", "rule_count")}
    assert flags.rule_errors(given).count() == 0


def test_publish_fold(spark):
    cs = spark.createDataFrame([("f", 1, 0), ("f", 2, 0), ("f", 3, 1), ("f", 4, 5)], "key string, seq bigint, expected bigint")
    assert sorted((r.seq, r.revision) for r in flags.publish(cs).collect()) == [(1, 1), (3, 2)]


def test_balanced_feed(spark):
    df = spark.createDataFrame([(f"s{s}", s * 100 + i) for s in range(5) for i in range(10)], "source string, ts int")
    out = feeds.balanced(df, "source", [F.desc("ts")], 20).collect()
    assert len(out) == 20 and all(sum(r.source == f"s{s}" for r in out) == 4 for s in range(5))


def test_coverage(spark):
    t = lambda *a: dt.datetime(2026, 8, *a)
    df = spark.createDataFrame([("p", "u1", t(13, 1), 10), ("p", "u2", t(12, 1), 0), ("p", "u3", None, 5)], "k string, url string, published timestamp, chars int")
    r = feeds.coverage(df, "k", F.lit("2026-08-13 02:00:00").cast("timestamp"), "Asia/Shanghai").first()
    assert (r.today, r.yesterday, r.undated, r.nonempty_rate) == (1, 1, 1, 0.667)
    two = spark.createDataFrame([("ok", 5, 2), ("http_error", 0, 0)], "status string, today int, yesterday int")
    s = feeds.rollup(two).first()
    assert (s.available_rate, s.recent_items, s.publishers) == (0.5, 7, 2)


def test_completeness(spark):
    toc = spark.createDataFrame([("b", 1), ("b", 2), ("b", 3)], "item string, ch int")
    records = spark.createDataFrame([("b", 1), ("b", 2), ("b", 2), ("b", 99)], "item string, ch int")
    r = content.completeness(toc, records, "item", "ch").first()
    assert (r.expected, r.present, r.missing, r.unmatched, r.duplicate, round(r.coverage, 3)) == (3, 2, 1, 1, 1, 0.667)


def test_volume_split(spark):
    rows = [("a", 1, 1, 2), ("a", 2, 3, 2), ("a", 2, 4, 2), ("b", 2, 3, 2), ("c", 1, 4, 2), ("c", 2, 2, 2)]
    out = content.split_by_markers(spark.createDataFrame(rows, "g string, volume int, idx int, n int"), "g", "n").collect()
    assert sorted((r.g, r.volume, r.first, r.next) for r in out) == [("a", 1, 0, 3), ("a", 2, 3, None)]


def test_tree(spark):
    nodes = spark.createDataFrame([("i", "a", None, 1, "t1"), ("i", "b", "a", 1, None), ("i", "c", "b", 1, "t2"), ("i", "d", "a", 2, "t3")], "item string, node_id string, parent_id string, ord int, target_id string")
    flat = content.flatten_tree(nodes, "item")
    assert [(r.node_id, r.depth) for r in flat.orderBy("path").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    kept = content.prune_tree(flat, spark.createDataFrame([("i", "t2")], "item string, target_id string"), "item")
    assert {(r.node_id, r.target_id) for r in kept.collect()} == {("a", None), ("b", None), ("c", "t2")}


def test_chunks(spark):
    text = "一二三四五六七八。" * 400
    out = content.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x" * 4000)], "id int, t string"), "t").orderBy("id", "chunk").collect()
    assert all(len(r.chunk_text) <= 1501 for r in out)
    one = [r for r in out if r.id == 1]
    assert all(r.chunk_text.endswith("。") for r in one)
    assert one[0].pos == 0 and one[1].pos == len(one[0].chunk_text) - 150 and one[-1].pos + len(one[-1].chunk_text) == len(text)
    assert {r.id for r in out} == {1, 4}


def test_chunk_ends(spark):
    """A stop counts only beyond 0.55 of the size; a text within the size stays as it is; all white space is trimmed."""
    rows = [(1, "x" * 825 + "。" + "x" * 2000), (2, "x" * 826 + "。" + "x" * 1999), (3, " short\u3000"), (4, "y" * 1500 + "\u3000\n"), (5, "z" * 1499 + "\t" + "z" * 600), (6, " " * 4000)]
    got = {}
    for r in content.chunks(spark.createDataFrame(rows, "id int, t string"), "t").orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append((r.chunk, len(r.chunk_text)))
    assert got == {1: [(0, 1500), (1, 1476)], 2: [(0, 827), (1, 1500), (2, 799)], 3: [(0, 7)], 4: [(0, 1500), (1, 150)], 5: [(0, 1499), (1, 750)]}


def test_parents(spark):
    """The parent is one level above, else there is none; levels under 1 count as 1."""
    rows = [("g", i, level) for i, level in enumerate([1, 3, 2, 3, 1, 3, 0, 2, None, 2])]
    got = {r.o: r.parent for r in content.parents(spark.createDataFrame(rows, "g string, o long, level int"), "g", "o", "level").collect()}
    assert got == {0: None, 1: None, 2: 0, 3: 2, 4: None, 5: None, 6: None, 7: 6, 8: None, 9: 8}


def test_deep_trees_and_cycles(spark):
    deep = spark.createDataFrame([("i", f"n{k}", f"n{k - 1}" if k else None, 1) for k in range(70)], "item string, node_id string, parent_id string, ord int")
    assert content.flatten_tree(deep, "item").agg({"depth": "max"}).first()[0] == 69
    with pytest.raises(ValueError):
        content.flatten_tree(spark.createDataFrame([("i", "a", "b", 1), ("i", "b", "a", 1)], "item string, node_id string, parent_id string, ord int"), "item")


def test_closed_days(spark):
    days = spark.createDataFrame([("19491231",), ("19500101",), ("19600615",), ("19700101",), ("20010101",), (None,)], "d string")
    shut = lambda **rules: [r.x for r in days.select(calendar.is_closed(F.col("d"), **rules).alias("x")).collect()]
    assert shut() == [False] * 6
    assert shut(lo="19500101", hi="20001231")[:5] == [True, False, False, False, True]
    assert shut(ranges=[("19600601", "19600615")], days_missing=["19700101"])[:5] == [False, False, True, True, False]
    assert shut(years=[1950, 1960])[:5] == [True, False, False, True, True] and shut(years=[])[:5] == [True] * 5
    assert shut(year_range=(1950, 1970), year_out=1960, years_missing=[1970])[:5] == [True, False, True, True, True]


def test_calendar(spark):
    d = spark.createDataFrame([(dt.date(2020, 2, 28),), (dt.date(2020, 3, 1),)], "d date")
    got = {(r.grain, r.value) for r in calendar.missing(d, "d", "2019-12-31", "2020-03-02").collect()}
    assert got == {("year", "2019"), ("month", "2020-01"), ("day", "2020-03-02"), ("day", "2020-02-29")} | {("day", f"2020-02-{i:02}") for i in range(1, 28)}
    ids = spark.createDataFrame([("20240229",), ("20230229",), ("202401",), ("x",)], "i string")
    assert [r[0] for r in ids.select(calendar.is_issue_id(F.col("i"))).collect()] == [True, False, True, False]


def test_crawl(spark):
    rows = [("pending", 8), ("error", 2), ("partial", 3), ("complete", 1)]
    r = crawl.action_state(spark.createDataFrame(rows, "status string, attempts int"), 3).first()
    assert (r.retry_errors, r.actionable, r.terminal, r.recoverable) == (False, 1, 1, 1)
    r = crawl.action_state(spark.createDataFrame(rows[1:], "status string, attempts int"), 3).first()
    assert r.retry_errors and r.actionable == 1


def test_blocks(spark):
    rows = [("p", 1, "heading", " One "), ("p", 2, "heading", "Two"), ("p", 3, "text", "body"), ("p", 4, "text", "- 12 -"), ("p", 5, "page_number", "x"), ("p", 6, "heading", "Three"), ("p", 7, "text", "")]
    df = blocks.clean(spark.createDataFrame([(*r, 2) for r in rows], "g string, seq int, type string, text string, level int"))
    assert [(r.chapter, r.title, r.blocks) for r in blocks.chapters(df, "g", "seq").orderBy("chapter").collect()] == [(1, "One - Two", 3), (2, "Three", 1)]
    assert blocks.markdown(df, "g", "seq").first().markdown == "## One\n\n## Two\n\nbody\n\n## Three"
    assert blocks.unnamed_headings(df).count() == 3


@pytest.mark.parametrize(
    "title,want",
    [("文集（1893-1949）", ("period", "文集", 1893, 1949)), ("全集 第二十八卷", ("volume", "全集", 28, 28)), ("选集（全五册）", ("all", "选集", 1, 5)), ("文选 第一-三卷", ("range", "文选", 1, 3)), ("Plain", ("plain", "Plain", None, None))],
)
def test_titles(spark, title, want):
    assert tuple(spark.createDataFrame([(title,)], "t string").select(titles.describe(F.col("t")).alias("d")).first().d) == want


def test_issue_ids(spark):
    rules = [titles.NameRule(r"^(\d{4})年(\d{1,2})期", "{1}{2:02}"), titles.NameRule(r"(\d{8})", "{1}")]
    df = spark.createDataFrame([("1987年3期.pdf",), ("a19460515b.pdf",), ("none.pdf",)], "n string")
    assert [r[0] for r in df.select(titles.issue_id(F.col("n"), rules)).collect()] == ["198703", "19460515", None]


def test_moderation(spark):
    comments = spark.createDataFrame([("c1", "visible"), ("c2", "visible")], "comment_id string, status string")
    reports = spark.createDataFrame([("r1", "c1", "u", "pending"), ("r2", "c1", "v", "dismissed")], "report_id string, comment_id string, reporter_id string, status string")
    acts = spark.createDataFrame([("c1", "hide")], "comment_id string, action string")
    new_comments, new_reports = reader.moderate(comments, reports, acts)
    assert {tuple(r) for r in new_comments.collect()} == {("c1", "hidden"), ("c2", "visible")}
    assert {r.report_id: r.status for r in new_reports.collect()} == {"r1": "resolved", "r2": "dismissed"}
    assert [(r.recipient_id, r.event_key) for r in reader.notify(reports, acts).collect()] == [("u", "report:r1:hide")]


def test_title_order_and_outline_edges(spark):
    titles_ = spark.createDataFrame([("中",), ("阿",), ("波",)], "t string")
    assert [r.t for r in content.in_title_order(titles_, "t").collect()] == ["阿", "波", "中"]
    rows = [("i", "a", None, 1, "", None), ("i", "b", "a", 1, "B", None), ("i", "c", "b", 1, " C ", "p"), ("i", "d", "a", 2, "D", None), ("i", "e", "c", 1, "", "q")]
    nodes = spark.createDataFrame(rows, "item string, node_id string, parent_id string, ord int, title string, dest string")
    assert {(r.node_id, r.parent_id, r.depth, r.title) for r in content.outline(nodes, "item").collect()} == {("b", None, 0, "B"), ("c", "b", 1, "C")}


def test_hits_without_highlights(spark):
    hits = spark.createDataFrame([("k", "t", None)], "_id string, title string, content string")
    assert search.hit_rows(hits, "_id").columns == ["documentId", "title", "content"]
    assert search.listed(hits, ["content", "other", "_id"]).columns == ["content", "_id"]
    with pytest.raises(ValueError):
        search.term_totals(hits, "title", [" "])
    assert search.closest_titles(hits, "title", " ", "_id").count() == 0 and search.in_book(hits, [F.col("_id")], "title", " ").count() == 0


def test_search_condition(spark):
    from lectern.operators import search

    rows = [(1, "An Urgent thing", "x", "s", "2024-01-01"), (2, "x", "so Urgent", "t", "2025-01-01"), (3, None, "urgent", "s", "2024-06-01"), (4, "x", None, "s", "2024-06-01")]
    df = spark.createDataFrame(rows, "k int, title string, content string, source string, date string")
    cond = lambda q, **told: sorted(r.k for r in df.where(search.search_condition(q, F.col("title"), F.col("content"), **told)).collect())
    dates = (F.col("date"), "2024-01-01", "2024-12-31")
    assert cond('"Urgent"') == [1, 2] and cond('"Urgent"', dates=dates) == [1]
    assert cond('"Urgent"', dates=dates, strict_reference=True) == [1, 2] and cond("urgent", dates=dates, strict_reference=True) == [1, 3]
    assert cond('"Urgent"', source=(F.col("source"), "s"), dates=dates, strict_reference=True) == [1, 3]
    assert cond('"U?gent*"') == [1, 2] and cond('"Urgent"', dates=(F.col("date"), "2024-01-01", None)) == [1, 2]


def test_fallback_finds_matches_once(spark):
    from lectern.operators import search

    every = spark.createDataFrame([(i,) for i in range(5)], "k int")
    pick = lambda cond: [r.k for r in search.with_fallback(every.where(cond), every, [F.desc("k")], 2).orderBy("k").collect()]
    assert pick("k < 1") == [0] and pick("k < 4") == [2, 3] and pick("k > 9") == [3, 4]
    assert search.with_fallback(every.limit(0), every.limit(0), [F.desc("k")], 2).count() == 0


def test_reports_are_bounded(spark, tmp_path, monkeypatch):
    from lectern.sources import sinks

    df = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    sinks.csv_report(df, str(tmp_path / "c"), ["v", "k"])
    (part,) = (tmp_path / "c").glob("*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfv,k\n")
    sinks.json_report(df, str(tmp_path / "j"), ["k", "v"])
    assert sorted(line for p in (tmp_path / "j").glob("*.json") for line in p.read_text().split()) == ['{"k":1,"v":null}', '{"k":2,"v":"b"}']
    monkeypatch.setattr(sinks, "MOST_REPORT", 1)
    for write in (lambda: sinks.csv_report(df, str(tmp_path / "d"), ["k"]), lambda: sinks.markdown_table(df, ["k"], [F.col("k")])):
        with pytest.raises(ValueError, match="more than 1"):
            write()


def test_short_sentences_are_no_page_marks(spark):
    rows = [("Vi.", "text"), ("vi", "text"), ("12", "text"), ("12.", "text"), (" - 3 -", "text"), ("Watermarks", "text"), ("7", "page_number"), (" ", None)]
    df = spark.createDataFrame(rows, "text string, type string")
    assert sorted(r.text for r in blocks.clean(df, None, bare=True).collect()) == ["- 3 -", "12.", "Vi.", "Watermarks"]
    assert blocks.clean(df).count() == 0


def test_cleaned_blocks_of_short_lines(spark, tmp_path):
    import duckdb

    import __spark_entry__

    rows = [(1, "Vi.\nLong line.\nxii\n\n 4 "), (2, "- 12 -\nWatermark\nC"), (3, None), (4, "7\n\u3000\n\u00a0z\u00a0")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    documents = duckdb.sql(f"FROM '{tmp_path}/documents.parquet/*.parquet'")  # noqa: F841
    want = duckdb.sql(__spark_entry__.oracle_sql()["cleaned_blocks"]).fetchall()
    assert sorted(map(tuple, __spark_entry__.queries()["cleaned_blocks"](spark, str(tmp_path)).collect())) == sorted(want) == [(1, 2), (2, 2), (4, 1)]
