"""Feed, calendar, content and crawl queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import calendar, content, crawl, feeds
from lectern.registry import Registry, table

NOW = "2024-01-15 02:00:00"


def register(r: Registry) -> None:
    @r.query(
        "balanced_feed_100",
        """
        WITH n AS (SELECT greatest(1, 100 // count(DISTINCT event_type)) AS q FROM events),
        k AS (SELECT event_id, ts, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
        SELECT event_id, ts, event_type FROM k, n ORDER BY rn > q, ts DESC, event_id DESC LIMIT 100
        """,
    )
    def balanced_feed_100(spark, sf_dir):
        return feeds.balanced(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), "event_type", [F.desc("ts"), F.desc("event_id")], 100)

    @r.query(
        "feed_last_wins",
        "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    )
    def feed_last_wins(spark, sf_dir):
        e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
        return feeds.last_by_key(e, "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")

    @r.query(
        "day_buckets_utc8",
        f"""
        WITH d AS (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, CAST(TIMESTAMP '{NOW}' + INTERVAL 8 HOUR AS DATE) AS today FROM events)
        SELECT CASE WHEN day IS NULL THEN 'undated' WHEN day = today THEN 'today' WHEN day = today - 1 THEN 'yesterday' WHEN day > today THEN 'future' ELSE 'older' END AS bucket,
               count(*) AS n FROM d GROUP BY 1
        """,
    )
    def day_buckets_utc8(spark, sf_dir):
        e = table(spark, sf_dir, "events").select(feeds.day_bucket(F.col("ts").cast("timestamp"), F.lit(NOW).cast("timestamp"), "Asia/Shanghai").alias("bucket"))
        return e.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))

    @r.query(
        "richness_by_source",
        """
        SELECT source AS publisher, count(*) AS item_count, count(DISTINCT text) AS urls, round_even(count(*) FILTER (n_chars > 0) / count(*), 3) AS nonempty_rate,
               round_even(count(*) FILTER (n_chars >= 1000) / count(*), 3) AS long_rate, CAST(round_even(median(n_chars), 0) AS BIGINT) AS median_chars
        FROM documents GROUP BY source
        """,
    )
    def richness_by_source(spark, sf_dir):
        d = table(spark, sf_dir, "documents").select(F.col("source").alias("publisher"), F.sha2("text", 256).alias("url"), F.lit(None).cast("timestamp").alias("published"), F.col("n_chars").alias("chars"))
        return feeds.coverage(d, "publisher", F.lit(NOW).cast("timestamp"), "Asia/Shanghai").select("publisher", "item_count", "urls", "nonempty_rate", "long_rate", "median_chars")

    @r.query(
        "coverage_rollup",
        """
        WITH p AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'http_error' ELSE 'ok' END AS status, count(*) FILTER (event_type = 'click') AS today, count(*) FILTER (event_type = 'view') AS yesterday FROM events GROUP BY user_id)
        SELECT count(*) AS publishers, count(*) FILTER (status = 'ok') AS available, round_even(count(*) FILTER (status = 'ok') / count(*), 3) AS available_rate,
               count(*) FILTER (status = 'ok' AND today > 0) AS with_today, CAST(coalesce(sum(today + yesterday) FILTER (status = 'ok'), 0) AS BIGINT) AS recent_items FROM p
        """,
    )
    def coverage_rollup(spark, sf_dir):
        e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("today"), F.count_if(F.col("event_type") == "view").alias("yesterday"))
        return feeds.rollup(e.withColumn("status", F.when(F.col("user_id") % 4 == 0, "http_error").otherwise("ok")))

    @r.query(
        "round_robin",
        "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256(CAST(o_orderkey AS VARCHAR)) DESC, o_orderkey) AS turn FROM orders",
    )
    def round_robin(spark, sf_dir):
        o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("name"))
        return feeds.round_robin(o, "o_custkey", "name").select("o_custkey", F.col("name").cast("bigint").alias("o_orderkey"), "turn")

    @r.query(
        "missing_days",
        """
        WITH h AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
        e AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
        y AS (SELECT DISTINCT year(day) AS y FROM h), m AS (SELECT DISTINCT year(day) AS y, date_trunc('month', day) AS m FROM h)
        SELECT 'year' AS grain, CAST(y AS VARCHAR) AS value FROM (SELECT DISTINCT year(day) AS y FROM e) WHERE y NOT IN (SELECT y FROM y)
        UNION ALL SELECT 'month', strftime(mm, '%Y-%m') FROM (SELECT DISTINCT year(day) AS yy, date_trunc('month', day) AS mm FROM e) WHERE yy IN (SELECT y FROM y) AND mm NOT IN (SELECT m FROM m)
        UNION ALL SELECT 'day', strftime(day, '%Y-%m-%d') FROM e WHERE date_trunc('month', day) IN (SELECT m FROM m) AND day NOT IN (SELECT day FROM h)
        """,
    )
    def missing_days(spark, sf_dir):
        return calendar.missing(table(spark, sf_dir, "orders"), "o_orderdate", "1994-01-01", "2001-12-31")

    @r.query(
        "range_blackout",
        """SELECT o_orderkey FROM orders WHERE NOT (CAST(o_orderdate AS DATE) BETWEEN DATE '1995-02-01' AND DATE '1996-10-31')
           AND NOT (CAST(o_orderdate AS DATE) BETWEEN DATE '1999-12-30' AND DATE '2000-01-02')""",
    )
    def range_blackout(spark, sf_dir):
        ranges = spark.sql("SELECT * FROM VALUES (DATE '1995-02-01', DATE '1996-10-31'), (DATE '1999-12-30', DATE '2000-01-02') AS t(lo, hi)")
        return calendar.outside_ranges(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", ranges).select("o_orderkey")

    @r.query(
        "period_membership",
        """
        WITH p(name, lo, hi) AS (VALUES ('first', DATE '1995-01-01', DATE '1997-06-30'), ('second', DATE '1997-01-01', DATE '1998-12-31'), ('third', DATE '1999-01-01', NULL))
        SELECT o_orderkey, name FROM orders, p WHERE CAST(o_orderdate AS DATE) >= lo AND (hi IS NULL OR CAST(o_orderdate AS DATE) <= hi)
        """,
    )
    def period_membership(spark, sf_dir):
        periods = spark.sql("SELECT * FROM VALUES ('first', DATE '1995-01-01', DATE '1997-06-30'), ('second', DATE '1997-01-01', DATE '1998-12-31'), ('third', DATE '1999-01-01', CAST(NULL AS DATE)) AS t(name, lo, hi)")
        return calendar.in_periods(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", periods).select("o_orderkey", "name")

    @r.query(
        "issue_runs",
        """
        WITH d AS (SELECT DISTINCT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS x FROM orders),
        i AS (SELECT *, x - row_number() OVER (PARTITION BY o_custkey ORDER BY x) AS g FROM d)
        SELECT o_custkey, min(x) AS first, max(x) AS last, count(*) AS n FROM i GROUP BY o_custkey, g
        """,
    )
    def issue_runs(spark, sf_dir):
        o = table(spark, sf_dir, "orders").select("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("x"))
        return calendar.runs(o, "o_custkey", "x")

    @r.query(
        "compressed_numbers",
        """
        WITH s AS (SELECT DISTINCT o_custkey, o_orderkey % 97 AS x FROM orders),
        b AS (SELECT o_custkey, min(x) FILTER (x < 90) AS lo, max(x) FILTER (x < 90) AS hi, count(*) FILTER (x < 90) AS n,
                     coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FILTER (x < 90), '') AS normal, coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FILTER (x >= 90), '') AS extra FROM s GROUP BY o_custkey),
        h AS (SELECT o_custkey, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS holes FROM (SELECT o_custkey, unnest(range(lo, hi + 1)) AS v FROM b) q
              WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_custkey = q.o_custkey AND s.x = q.v) GROUP BY o_custkey)
        SELECT o_custkey, CASE WHEN n > 0 AND hi - lo + 1 - n <= 5 THEN lo || '-' || hi ELSE normal END AS numbers,
               CASE WHEN n = 0 OR hi - lo + 1 - n <= 5 THEN coalesce(holes, '') ELSE '' END AS holes, extra FROM b LEFT JOIN h USING (o_custkey)
        """,
    )
    def compressed_numbers(spark, sf_dir):
        return calendar.compress_sequence(table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 97).alias("x")), "o_custkey", "x")

    @r.query(
        "best_source_per_key",
        "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1",
    )
    def best_source_per_key(spark, sf_dir):
        li = table(spark, sf_dir, "lineitem").withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
        return content.best_by_key(li, ["l_orderkey"], [F.col("l_quantity"), F.col("l_discount")], "pos")[0].select("l_orderkey", "l_linenumber", "l_quantity")

    @r.query(
        "superseded_sources",
        "SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn > 1 GROUP BY 1",
    )
    def superseded_sources(spark, sf_dir):
        li = table(spark, sf_dir, "lineitem").withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
        lost = content.best_by_key(li, ["l_orderkey"], [F.col("l_quantity"), F.col("l_discount")], "pos")[1]
        return lost.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))

    @r.query(
        "merge_delivery",
        """
        WITH l AS (SELECT c_custkey AS id, c_custkey % 7 AS rev, c_name AS title FROM customer), r AS (SELECT p_partkey AS id, p_partkey % 5 AS rev, p_name AS title FROM part)
        SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NOT NULL AND r.id IS NOT NULL THEN greatest(l.rev, r.rev) + 1 ELSE coalesce(l.rev, r.rev) END AS rev, coalesce(l.title, r.title) AS title FROM l FULL JOIN r ON l.id = r.id
        """,
    )
    def merge_delivery(spark, sf_dir):
        side = lambda t, key, m, title: table(spark, sf_dir, t).select(F.col(key).alias("id"), (F.col(key) % m).alias("rev"), F.col(title).alias("title"))
        return content.merge_delivery(side("customer", "c_custkey", 7, "c_name"), side("part", "p_partkey", 5, "p_name"), "id", "rev")

    @r.query(
        "locf_targets",
        "SELECT event_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS target FROM events",
    )
    def locf_targets(spark, sf_dir):
        e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("direct"))
        return content.carry_forward(e, "user_id", "event_id", "direct").select("event_id", "target")

    @r.query(
        "nearest_ancestors",
        """
        WITH n AS (SELECT user_id, event_id AS o, greatest(1, event_id % 4) AS l FROM events),
        q AS (SELECT *, (SELECT max(p.o) FROM n p WHERE p.user_id = n.user_id AND p.o < n.o AND p.l < n.l) AS near FROM n)
        SELECT q.user_id, q.o AS event_id, CASE WHEN m.l = q.l - 1 THEN q.near END AS parent FROM q LEFT JOIN n m ON m.o = q.near
        """,
    )
    def nearest_ancestors(spark, sf_dir):
        e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 4).cast("int").alias("level"))
        return content.parents(e, "user_id", "event_id", "level").select("user_id", "event_id", "parent")

    @r.query(
        "segments_headings",
        """
        WITH m AS (SELECT user_id, event_id, event_type IN ('signup', 'purchase') AS h FROM events),
        o AS (SELECT *, CASE WHEN h AND NOT coalesce(lag(h) OVER (PARTITION BY user_id ORDER BY event_id), false) THEN 1 ELSE 0 END AS opens FROM m)
        SELECT event_id, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS segment FROM o
        """,
    )
    def segments_headings(spark, sf_dir):
        e = table(spark, sf_dir, "events")
        return content.segments(e, "user_id", "event_id", F.col("event_type").isin("signup", "purchase")).select("event_id", "segment")

    @r.query(
        "adjacent_dedup",
        """
        WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
        k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM l WHERE line <> '')
        SELECT doc_id, count(*) AS kept FROM k WHERE b IS NULL OR b <> line GROUP BY doc_id
        """,
    )
    def adjacent_dedup(spark, sf_dir):
        lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        return content.drop_adjacent_repeats(lines, "doc_id", "pos", F.trim("line")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))

    @r.query(
        "asof_last_signup",
        """SELECT e.event_id, max(s.event_id) AS signup FROM events e LEFT JOIN events s ON s.user_id = e.user_id AND s.event_type = 'signup' AND s.event_id <= e.event_id GROUP BY e.event_id""",
    )
    def asof_last_signup(spark, sf_dir):
        e = table(spark, sf_dir, "events").select("user_id", "event_id")
        marks = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").alias("signup"))
        return content.as_of(e, marks, "user_id", "event_id", "signup").select("event_id", "signup")

    @r.query(
        "completeness",
        """
        WITH t AS (SELECT DISTINCT l_orderkey % 500 AS item, l_partkey % 20 AS ch FROM lineitem), r AS (SELECT o_orderkey % 500 AS item, o_custkey % 23 AS ch, count(*) AS n FROM orders GROUP BY 1, 2),
        b AS (SELECT coalesce(t.item, r.item) AS item, t.item IS NOT NULL AS w, coalesce(n, 0) AS n FROM t FULL JOIN r ON t.item = r.item AND t.ch = r.ch)
        SELECT item, count(*) FILTER (w) AS expected, count(*) FILTER (w AND n > 0) AS present, count(*) FILTER (w AND n = 0) AS missing, CAST(coalesce(sum(n) FILTER (NOT w), 0) AS BIGINT) AS unmatched,
               CAST(coalesce(sum(n - 1) FILTER (w AND n > 1), 0) AS BIGINT) AS duplicate, CASE WHEN count(*) FILTER (w) = 0 THEN 1.0::DOUBLE ELSE count(*) FILTER (w AND n > 0) / count(*) FILTER (w) END AS coverage FROM b GROUP BY item
        """,
    )
    def completeness(spark, sf_dir):
        of = lambda t, item, ch, m: table(spark, sf_dir, t).select((F.col(item) % 500).alias("item"), (F.col(ch) % m).alias("ch"))
        return content.completeness(of("lineitem", "l_orderkey", "l_partkey", 20), of("orders", "o_orderkey", "o_custkey", 23), "item", "ch")

    @r.query(
        "integrity_errors",
        """
        SELECT 'label_without_document' AS code, CAST(l.doc_id AS VARCHAR) AS object FROM labels l WHERE l.doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
        UNION ALL SELECT 'customer_without_supplier', CAST(o_custkey AS VARCHAR) FROM orders WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey)
        """,
    )
    def integrity_errors(spark, sf_dir):
        t = lambda n: table(spark, sf_dir, n)
        return content.integrity_errors(
            ("label_without_document", t("labels"), t("documents"), "doc_id", "doc_id"), ("customer_without_supplier", t("orders"), t("supplier"), "o_custkey", "s_suppkey")
        )

    @r.query(
        "chunk_documents",
        """
        WITH RECURSIVE c AS (
          SELECT doc_id, text, length(text) AS n, 0 AS chunk, 0 AS a, NULL::BIGINT AS b FROM documents WHERE length(text) > 1500
          UNION ALL
          SELECT doc_id, text, n, chunk + 1, CASE WHEN chunk = 0 THEN 0 ELSE CAST(b - 150 AS INT) END,
            (SELECT CASE WHEN s + 1500 >= n THEN n WHEN k > 826 THEN s + k ELSE s + 1500 END FROM (SELECT s, length(regexp_replace(substr(text, s + 1, 1501), '(?s)[^。！？\n]*$', '')) AS k
              FROM (SELECT CASE WHEN chunk = 0 THEN 0 ELSE CAST(b - 150 AS INT) END AS s)))
          FROM c WHERE chunk = 0 OR b < n),
        space AS (SELECT string_agg(chr(x), '') AS chars FROM (SELECT unnest([9, 10, 11, 12, 13, 32, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288, 65279]) AS x)),
        cut AS (SELECT doc_id, chunk, a, trim(substr(text, a + 1, CAST(b - a AS INT)), chars) AS t FROM c, space WHERE chunk > 0)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1 AS INT) AS chunk, a AS pos, md5(t) AS digest FROM cut WHERE t <> ''
        UNION ALL
        SELECT doc_id, 0, 0, md5(text) FROM documents WHERE length(text) BETWEEN 1 AND 1500
        """,
    )
    def chunk_documents(spark, sf_dir):
        return content.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "chunk", "pos", F.md5("chunk_text").alias("digest"))

    crawl_sql = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'pending' WHEN 2 THEN 'error' WHEN 3 THEN 'partial' ELSE 'complete' END AS status, CAST(user_id % 5 AS INT) AS attempts, ts FROM events"

    def articles(spark, sf_dir):
        e, k = table(spark, sf_dir, "events"), F.col("event_id") % 5
        status = F.when(k == 1, "pending").when(k == 2, "error").when(k == 3, "partial").otherwise("complete")
        return e.select(F.col("event_id").alias("url"), status.alias("status"), (F.col("user_id") % 5).cast("int").alias("attempts"), F.col("ts").alias("catalog_date"))

    @r.query("status_summary", f"SELECT status, count(*) AS n, CAST(coalesce(sum(attempts), 0) AS BIGINT) AS attempts FROM ({crawl_sql}) GROUP BY status")
    def status_summary(spark, sf_dir):
        return crawl.status_summary(articles(spark, sf_dir))

    @r.query(
        "action_state",
        f"""
        WITH c AS (SELECT count(*) AS total, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status IN ('error', 'partial') AND attempts < 3) AS recoverable,
                          count(*) FILTER (status IN ('error', 'partial') AND attempts >= 3) AS terminal FROM ({crawl_sql}))
        SELECT *, CASE WHEN pending > 0 THEN pending ELSE recoverable END AS actionable, pending = 0 AND recoverable > 0 AS retry_errors FROM c
        """,
    )
    def action_state(spark, sf_dir):
        return crawl.action_state(articles(spark, sf_dir), 3)

    @r.query("pending_articles", f"SELECT event_id AS url, status, attempts FROM ({crawl_sql}) WHERE status IN ('pending', 'error', 'partial') AND (status = 'pending' OR attempts < 3)")
    def pending_articles(spark, sf_dir):
        return crawl.pending(articles(spark, sf_dir), True, 3).select("url", "status", "attempts")

    @r.query(
        "best_variant",
        "SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey DESC) AS rn FROM part) WHERE rn = 1",
    )
    def best_variant(spark, sf_dir):
        return crawl.best_variant(table(spark, sf_dir, "part"), "p_brand", ["p_size", "p_retailprice", "p_partkey"]).select("p_brand", "p_partkey", "p_size")

    @r.query(
        "longest_zone",
        r"""
        WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages), z AS (SELECT DISTINCT unnest(['com', 'org', 'example.com', 'example.org', 'net']) AS zone)
        SELECT page_id, host, zone FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(zone) DESC) AS rn FROM h JOIN z ON host = zone OR ends_with(host, '.' || zone)) WHERE rn = 1
        """,
    )
    def longest_zone(spark, sf_dir):
        zones = spark.createDataFrame([(z,) for z in ("com", "org", "example.com", "example.org", "net")], "zone string")
        hosts = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/:]+)", 1).alias("host"))
        return crawl.longest_suffix(hosts, zones)
