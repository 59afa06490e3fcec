"""Queries of trees, pages, notes, streams' batch twins and small relational steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import blocks, calendar, content, crawl, feeds, reader, search, tables
from lectern.registry import Registry, table
from lectern.sources import readers, sinks
from lectern.streaming import streams


def register(r: Registry) -> None:
    def tree(spark, sf_dir):
        regions = table(spark, sf_dir, "region").select(F.lit("i").alias("item"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").alias("ord"), F.col("r_name").alias("target_id"))
        nations = table(spark, sf_dir, "nation").select(F.lit("i").alias("item"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("target_id"))
        return regions.unionByName(nations)

    @r.query(
        "tree_flatten",
        "SELECT 'r' || r_regionkey AS node_id, 0 AS depth, CAST(r_regionkey AS VARCHAR) AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 1, n_regionkey || '/' || n_nationkey FROM nation",
    )
    def tree_flatten(spark, sf_dir):
        return content.flatten_tree(tree(spark, sf_dir), "item").select("node_id", "depth", F.concat_ws("/", F.transform("path", lambda p: p.cast("string"))).alias("path"))

    @r.query(
        "tree_prune",
        """SELECT 'n' || n_nationkey AS node_id, n_name AS target_id FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
           UNION ALL SELECT 'r' || r_regionkey, NULL FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier))""",
    )
    def tree_prune(spark, sf_dir):
        suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
        wanted = table(spark, sf_dir, "nation").join(suppliers, "n_nationkey", "left_semi").select(F.lit("i").alias("item"), F.col("n_name").alias("target_id"))
        return content.prune_tree(content.flatten_tree(tree(spark, sf_dir), "item"), wanted, "item").select("node_id", "target_id")

    @r.query("chapter_neighbours", "SELECT event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
    def chapter_neighbours(spark, sf_dir):
        return tables.neighbours(table(spark, sf_dir, "events"), "user_id", "event_id", "event_id").select("event_id", "previous", "next")

    @r.query(
        "toc_page",
        "WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id, n > 15 AS has_more FROM p WHERE i >= 5 AND i < 15",
    )
    def toc_page(spark, sf_dir):
        return tables.toc_page(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 5, 10)

    @r.query(
        "people_search",
        "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00012') OR contains(lower(c_mktsegment), '00012') OR CAST(c_custkey AS VARCHAR) = '00012' ORDER BY c_name",
    )
    def people_search(spark, sf_dir):
        return tables.search_people(table(spark, sf_dir, "customer"), " 00012 ", "c_name", "c_mktsegment", "c_custkey").select("c_custkey", "c_name")

    @r.query(
        "resume_antijoin",
        """SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderstatus = 'F' AND d.o_custkey = o.o_custkey AND date_trunc('year', d.o_orderdate) = date_trunc('year', o.o_orderdate))""",
    )
    def resume_antijoin(spark, sf_dir):
        o = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
        return tables.not_done(o, o.where("o_orderstatus = 'F'"), ["o_custkey", "y"]).select("o_orderkey", "o_custkey")

    @r.query("usage_running", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS total FROM events")
    def usage_running(spark, sf_dir):
        return tables.running(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("event_id", F.round("total", 4).alias("total"))

    @r.query(
        "recent_items",
        """
        WITH l AS (SELECT user_id, event_type, max(event_id) AS e FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e DESC, event_type) AS k FROM l)
        SELECT n.user_id, n.event_type, greatest(0.0, least(100.0, v.value)) AS progress FROM n JOIN events v ON v.event_id = n.e WHERE k <= 3
        """,
    )
    def recent_items(spark, sf_dir):
        e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("value").alias("progress"), "event_id")
        return tables.recent_items(e, "user_id", "event_type", ["event_id"], 3)

    @r.query(
        "quote_anchors",
        """
        WITH n AS (SELECT d.doc_id, substr(d.text, 11, 5) AS prefix, substr(d.text, 16, 30) AS quote, substr(d.text, 46, 5) AS suffix, CASE WHEN doc_id % 2 = 0 THEN 15 ELSE 3 END AS start_offset, d.text FROM documents d),
        p AS (SELECT *, strpos(text, prefix || quote || suffix) AS k FROM n)
        SELECT doc_id, CAST(CASE WHEN substr(text, start_offset + 1, length(quote)) = quote THEN start_offset WHEN strpos(substr(text, k + 1), prefix || quote || suffix) = 0 THEN k - 1 + length(prefix) END AS INT) AS start FROM p
        """,
    )
    def quote_anchors(spark, sf_dir):
        d = table(spark, sf_dir, "documents").select("doc_id", "text")
        cut = lambda a, n: F.substring("text", a, n)
        notes = d.select("doc_id", cut(11, 5).alias("prefix"), cut(16, 30).alias("quote"), cut(46, 5).alias("suffix"), F.when(F.col("doc_id") % 2 == 0, 15).otherwise(3).alias("start_offset"))
        return tables.anchor(notes, d, "doc_id").select("doc_id", F.col("start").cast("int").alias("start"))

    @r.query("note_labels", """
        WITH t AS (SELECT user_id, event_id, event_type = 'signup' AS t FROM events), s AS (SELECT *, sum(CASE WHEN t THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM t)
        SELECT event_id, CASE WHEN t THEN repeat('*', row_number() OVER (PARTITION BY user_id, t ORDER BY event_id)) ELSE CAST(row_number() OVER (PARTITION BY user_id, s, t ORDER BY event_id) AS VARCHAR) END AS label FROM s
        """)  # fmt: skip
    def note_labels(spark, sf_dir):
        return blocks.note_labels(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup").select("event_id", "label")

    @r.query(
        "part_pages",
        """
        WITH p AS (SELECT l_orderkey, l_linenumber AS part, CAST(max(l_quantity) AS BIGINT) AS pages FROM lineitem GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(pages) OVER (PARTITION BY l_orderkey ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
        SELECT l_orderkey, part, CAST(before + 1 AS BIGINT) AS page FROM b
        """,
    )
    def part_pages(spark, sf_dir):
        parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("part")).agg(F.max("l_quantity").cast("bigint").alias("pages"))
        return blocks.page_of(parts.select("l_orderkey", "part", F.lit(1).cast("bigint").alias("page_in_part")), parts, "l_orderkey").select("l_orderkey", "part", "page")

    @r.query("windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
    def windowed_counts(spark, sf_dir):
        c = streams.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "value")
        return c.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))

    @r.query(
        "job_log_tail",
        "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 500",
    )
    def job_log_tail(spark, sf_dir):
        return streams.last_lines(table(spark, sf_dir, "events"), "event_type", "event_id").select("event_type", "event_id")

    @r.query("frames_folded", "SELECT conv_id AS conv, md5(string_agg(text, '' ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id")
    def frames_folded(spark, sf_dir):
        c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), F.struct("turn", "text").alias("seq"), F.lit("text_delta").alias("type"), "text", F.lit(None).cast("string").alias("ref"))
        return streams.fold_frames(c).select("conv", F.md5("text").alias("digest"))

    @r.query(
        "crawl_states",
        """
        WITH RECURSIVE e AS (SELECT user_id AS url, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 5 AS k FROM events),
        f AS (SELECT url, CAST(0 AS BIGINT) AS n, 'pending' AS status, 0 AS attempts FROM (SELECT DISTINCT url FROM e)
              UNION ALL SELECT e.url, e.n, CASE e.k WHEN 0 THEN 'downloading' WHEN 1 THEN 'complete' WHEN 2 THEN 'partial' WHEN 3 THEN 'error' ELSE CASE WHEN f.status = 'downloading' THEN 'pending' ELSE f.status END END,
                               f.attempts + CASE WHEN e.k = 0 THEN 1 ELSE 0 END FROM f JOIN e ON e.url = f.url AND e.n = f.n + 1)
        SELECT url, arg_max(status, n) AS status, arg_max(attempts, n) AS attempts FROM f GROUP BY url
        """,
    )
    def crawl_states(spark, sf_dir):
        name = F.element_at(F.array(*[F.lit(x) for x in ("start", "complete", "partial", "fail", "restart")]), (F.col("event_id") % 5 + 1).cast("int"))
        return streams.crawl_states_batch(table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.col("event_id").alias("seq"), name.alias("event")))

    @r.query("files_by_year", "SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, count(DISTINCT strftime(o_orderdate, '%Y%m%d')) AS files FROM orders GROUP BY 1")
    def files_by_year(spark, sf_dir):
        o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("file"))
        return readers.by_year(o, F.col("file"), F.lit("")).select("year", F.size("files").cast("bigint").alias("files"))

    @r.query(
        "stale_and_missing",
        """SELECT CAST(c_custkey AS VARCHAR) AS path, 'stale' AS state FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
           UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), 'missing' FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)""",
    )
    def stale_and_missing(spark, sf_dir):
        key = lambda t, c: table(spark, sf_dir, t).select(F.col(c).cast("string").alias("path"))
        return sinks.stale_and_missing(key("customer", "c_custkey"), key("orders", "o_custkey"))

    @r.query("variant_families", "SELECT p_brand AS family, sha256(p_brand) AS key, count(DISTINCT p_name) AS urls FROM part GROUP BY p_brand")
    def variant_families(spark, sf_dir):
        return crawl.families(table(spark, sf_dir, "part").withColumn("url", F.col("p_name")), F.col("p_brand")).select("family", "key", F.size("urls").cast("bigint").alias("urls"))

    @r.query(
        "feed_probe",
        r"""SELECT CASE WHEN page_id % 7 = 0 THEN 'http_error' WHEN length(html) > 3000 THEN 'too_large' WHEN starts_with(lower(substr(ltrim(html), 1, 256)), '<!doctype html') OR starts_with(lower(substr(ltrim(html), 1, 256)), '<html') THEN 'html'
            WHEN regexp_matches(lower(substr(ltrim(html), 1, 256)), '<(rss|rdf|feed)[\s:>]') THEN 'ok' ELSE 'invalid' END AS status, count(*) AS n FROM pages GROUP BY 1""",
    )
    def feed_probe(spark, sf_dir):
        status = feeds.probe_status(F.when(F.col("page_id") % 7 == 0, 500).otherwise(200), F.length("html"), F.col("html"), 3000)
        return table(spark, sf_dir, "pages").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))

    @r.query("median_length", "SELECT source, median(length(text)) AS median_chars, sum(length(text))::BIGINT AS chars, sum(length(text)) > 33554432 AS over_budget FROM documents GROUP BY source")
    def median_length(spark, sf_dir):
        d = table(spark, sf_dir, "documents").withColumn("n", F.length("text"))
        return d.groupBy("source").agg(F.median("n").alias("median_chars"), F.sum("n").alias("chars"), (F.sum("n") > 32 << 20).alias("over_budget"))

    @r.query("available_dates", "SELECT event_id, CAST(CASE WHEN hour(ts + INTERVAL 8 HOUR) < 19 THEN CAST(ts + INTERVAL 8 HOUR AS DATE) - 1 ELSE CAST(ts + INTERVAL 8 HOUR AS DATE) END AS DATE) AS day FROM events")
    def available_dates(spark, sf_dir):
        return table(spark, sf_dir, "events").select("event_id", calendar.latest_available(F.col("ts").cast("timestamp")).alias("day"))

    @r.query("own_rows", "SELECT event_id FROM events WHERE user_id = 7")
    def own_rows(spark, sf_dir):
        return reader.own_rows(table(spark, sf_dir, "events"), 7).select("event_id")

    @r.query("notification_fan_out", "SELECT user_id AS recipient_id, 'report:' || event_id || ':hide' AS event_key, 'hide' AS kind FROM events WHERE event_type = 'click' AND event_id % 50 < 10")
    def notification_fan_out(spark, sf_dir):
        reports = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").alias("report_id"), (F.col("event_id") % 50).alias("comment_id"), F.col("user_id").alias("reporter_id"), F.lit("pending").alias("status"))
        return reader.notify(reports, spark.range(10).select(F.col("id").alias("comment_id"), F.lit("hide").alias("action")))

    @r.query(
        "hit_rows",
        """SELECT event_id AS "documentId", CASE WHEN event_type = 'click' THEN '<mark>click</mark>' ELSE event_type END AS title, CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE value END AS score FROM events""",
    )
    def hit_rows(spark, sf_dir):
        e, click = table(spark, sf_dir, "events"), F.col("event_type") == "click"
        marks = F.struct(F.when(click, F.array(F.lit("<mark>click</mark>"))).otherwise(F.array().cast("array<string>")).alias("title"))
        hits = e.select("event_id", F.col("event_type").alias("title"), F.when(F.col("event_type") != "view", F.col("value")).alias("score"), F.col("ts").alias("@timestamp"), marks.alias("highlight"))
        return search.hit_rows(hits, "event_id", ("@timestamp",), score="score")

    @r.query(
        "overlay_page",
        """
        WITH b AS (SELECT event_id, user_id AS logical_id, event_id % 3 AS version, value AS score, event_id AS seq, 1 AS side FROM events WHERE event_type <> 'click' ORDER BY value DESC, event_id LIMIT 200),
        d AS (SELECT event_id, user_id AS logical_id, event_id % 3 AS version, value AS score, event_id AS seq, 0 AS side FROM events WHERE event_type = 'click' ORDER BY value DESC, event_id LIMIT 200),
        m AS (SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY version DESC, score DESC, side, seq) AS n FROM (FROM b UNION ALL FROM d))
        SELECT event_id, side, (SELECT count(*) FROM m WHERE n = 1) AS total FROM m WHERE n = 1 ORDER BY score DESC, event_id LIMIT 20 OFFSET 20
        """,
    )
    def overlay_page(spark, sf_dir):
        e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("logical_id"), (F.col("event_id") % 3).alias("version"), F.col("value").alias("score"), F.col("event_id").alias("seq"), "event_type")
        side = lambda of: e.where(of).drop("event_type")
        state = spark.createDataFrame([], "logical_id bigint, version bigint, deleted boolean")
        page = search.overlay_page(side("event_type <> 'click'"), side("event_type = 'click'"), state, [F.desc("score"), F.col("event_id")], 2, 20)
        return page.select("event_id", "side", "total")

    @r.query("in_book_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 30")
    def in_book_search(spark, sf_dir):
        return search.in_book(table(spark, sf_dir, "documents").select("doc_id", "text"), [F.col("doc_id")], "text", " LICENSE ").select("doc_id")

    @r.query("closest_titles", "SELECT p_partkey, strpos(lower(p_name), 're') - 1 + (length(p_name) - 2) / 100 AS score FROM part WHERE contains(lower(p_name), 're') ORDER BY score, p_partkey LIMIT 6")
    def closest_titles(spark, sf_dir):
        return search.closest_titles(table(spark, sf_dir, "part"), "p_name", "re", "p_partkey").select("p_partkey", "score")

    @r.query(
        "term_totals",
        """
        SELECT 'license' AS term, CAST(sum((length(text) - length(replace(text, 'license', ''))) // 7) AS BIGINT) AS total FROM documents
        UNION ALL SELECT 'the', CAST(sum((length(text) - length(replace(text, 'the', ''))) // 3) AS BIGINT) FROM documents
        """,
    )
    def term_totals(spark, sf_dir):
        return search.term_totals(table(spark, sf_dir, "documents"), "text", ["license", " the ", "license", ""])

    @r.query(
        "size_budgets",
        "SELECT source, count(*) AS chapters, CAST(sum(n_chars) AS BIGINT) AS bytes, median(n_chars) AS median_bytes, sum(n_chars) <= 100000 AS fits FROM documents GROUP BY source",
    )
    def size_budgets(spark, sf_dir):
        return content.size_budgets(table(spark, sf_dir, "documents"), "source", "n_chars", 100_000)

    @r.query(
        "release_totals",
        "SELECT 'regions' AS name, (SELECT count(*) FROM region) AS n, 5 AS reported, (SELECT count(*) FROM region) = 5 AS ok UNION ALL SELECT 'nations', (SELECT count(*) FROM nation), 24, false UNION ALL SELECT 'pages', (SELECT count(*) FROM pages), NULL, false",
    )
    def release_totals(spark, sf_dir):
        report = spark.createDataFrame([("regions", 5), ("nations", 24)], "name string, reported int")
        return content.totals_against(report, **{n: table(spark, sf_dir, t) for n, t in (("regions", "region"), ("nations", "nation"), ("pages", "pages"))})

    @r.query(
        "outline_nodes",
        """SELECT 'n' || n_nationkey AS node_id, CASE WHEN n_regionkey <> 2 THEN 'r' || n_regionkey END AS parent_id, CASE WHEN n_regionkey <> 2 THEN 1 ELSE 0 END AS depth FROM nation
           UNION ALL SELECT 'r' || r_regionkey, NULL, 0 FROM region WHERE r_regionkey <> 2 AND r_regionkey IN (SELECT n_regionkey FROM nation)""",
    )
    def outline_nodes(spark, sf_dir):
        n, reg = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
        named = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
        roots = reg.select(F.lit("i").alias("item"), named("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("int").alias("ord"), F.when(F.col("r_regionkey") == 2, " ").otherwise(F.col("r_name")).alias("title"), F.lit(None).cast("string").alias("dest"))
        leaves = n.select(F.lit("i").alias("item"), named("n", "n_nationkey").alias("node_id"), named("r", "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("title"), F.col("n_name").alias("dest"))
        return content.outline(roots.unionByName(leaves), "item").select("node_id", "parent_id", "depth")

    @r.query("book_kinds", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'epub' WHEN 1 THEN 'mobi' WHEN 2 THEN 'reader-export' END AS kind FROM pages")
    def book_kinds(spark, sf_dir):
        names = F.array(F.lit("x/a.EPUB"), F.lit("b.azw3"), F.lit("c.v2.json"), F.lit("d.xyz"))
        return table(spark, sf_dir, "pages").select("page_id", readers.book_kind(F.element_at(names, (F.col("page_id") % 4 + 1).cast("int"))).alias("kind"))
