"""Queries of value functions: titles, numbers, dates, paths, marks, names. Each runs over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import codecs, dates, hashing, text, titles
from lectern.operators import calendar, crawl, flags, items, tables
from lectern.registry import Registry, table

#: Magic bytes and the types they tell.
MAGIC = (("FFD8FFE0", "image/jpeg"), ("89504E470D0A1A0A00", "image/png"), ("474946383961", "image/gif"), ("524946460000000057454250", "image/webp"), ("255044462D", "application/pdf"), ("504B0304", "application/zip"), ("1F8B08", "application/gzip"), ("00010203", None))


def _case(key, *values):
    """One of the values, by a key modulo their number."""
    out = F.lit(None)
    for i, v in enumerate(values):
        out = F.when(F.col(key) % len(values) == i, v).otherwise(out)
    return out


def register(r: Registry) -> None:
    @r.query("phrase_keys", "SELECT p_partkey, 'ab ' || p_name AS normal, 'ab ' || lower(p_name) AS phrase FROM part")
    def phrase_keys(spark, sf_dir):
        p, wide = table(spark, sf_dir, "part"), F.concat(F.lit(" ａｂ　\t "), F.col("p_name"), F.lit("　"))
        return p.select("p_partkey", text.normalise(wide).alias("normal"), text.phrase_key(F.upper(wide)).alias("phrase"))

    @r.query(
        "html_lines",
        r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|blockquote)\s*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
            '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM pages""",
    )
    def html_lines(spark, sf_dir):
        return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_lines(F.col("html"))).alias("digest"))

    @r.query("marked_parts", "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)license|token')) AS INT) AS marked, md5(text) AS digest FROM documents")
    def marked_parts(spark, sf_dir):
        parts = text.split_marks(text.highlight(F.col("text"), ["license", "token"]))
        return table(spark, sf_dir, "documents").select("doc_id", parts.alias("ps")).select("doc_id", F.size(F.filter("ps", lambda p: p["marked"])).alias("marked"), F.md5(F.array_join("ps.text", "")).alias("digest"))

    @r.query("safe_file_names", "SELECT p_partkey, p_name || '- a-b-c-' AS name FROM part")
    def safe_file_names(spark, sf_dir):
        return table(spark, sf_dir, "part").select("p_partkey", text.safe_file_name(F.concat(F.col("p_name"), F.lit(':  a/\\b*c?"<. .'))).alias("name"))

    @r.query(
        "chinese_numbers",
        """WITH n AS (SELECT p_partkey, CAST(p_partkey % 100 AS INT) AS n FROM part) SELECT p_partkey, n AS back, CASE WHEN n < 10 THEN substr('零一二三四五六七八九', n + 1, 1)
           ELSE CASE WHEN n >= 20 THEN substr('零一二三四五六七八九', n // 10 + 1, 1) ELSE '' END || '十' || CASE WHEN n % 10 > 0 THEN substr('零一二三四五六七八九', n % 10 + 1, 1) ELSE '' END END AS told FROM n""",
    )
    def chinese_numbers(spark, sf_dir):
        told = table(spark, sf_dir, "part").select("p_partkey", text.to_chinese(F.col("p_partkey") % 100).alias("told"))
        return told.select("p_partkey", "told", text.chinese_number(F.col("told")).alias("back"))

    @r.query("chinese_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
    def chinese_dates(spark, sf_dir):
        d = F.col("o_orderdate")
        day = F.replace(F.replace(text.to_chinese(F.dayofmonth(d)), F.lit("二十"), F.lit("廿")), F.lit("三十"), F.lit("卅"))
        told = F.concat(F.translate(F.year(d).cast("string"), "0123456789", "〇一二三四五六七八九"), F.lit("年"), text.to_chinese(F.month(d)), F.lit("月"), day, F.lit("日"))
        return table(spark, sf_dir, "orders").select("o_orderkey", text.chinese_date(told).alias("day"))

    @r.query(
        "title_parts",
        """SELECT p_partkey, p_name AS base, CASE p_partkey % 5 WHEN 0 THEN 'period' WHEN 1 THEN 'range' WHEN 2 THEN 'all' WHEN 3 THEN 'volume' ELSE 'plain' END AS kind,
           CASE p_partkey % 5 WHEN 0 THEN 1949 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 15 END AS first, CASE p_partkey % 5 WHEN 0 THEN 1976 WHEN 1 THEN 3 WHEN 2 THEN 12 WHEN 3 THEN 15 END AS last FROM part""",
    )
    def title_parts(spark, sf_dir):
        title = F.concat("p_name", _case("p_partkey", F.lit("(1949-1976)"), F.lit(" 第一-三卷"), F.lit("（全十二册）"), F.lit(" 第十五卷"), F.lit(" ")))
        return table(spark, sf_dir, "part").select("p_partkey", titles.describe(title).alias("d")).select("p_partkey", "d.*")

    @r.query("title_volumes", "SELECT p_name AS base, 'volume' AS kind, count(*) AS n, CAST(min(p_size) AS INT) AS first, CAST(max(p_size) AS INT) AS last FROM part GROUP BY p_name")
    def title_volumes(spark, sf_dir):
        return titles.volumes_of(table(spark, sf_dir, "part").select(F.concat_ws(" Vol. ", "p_name", "p_size").alias("title")), "title")

    @r.query("file_issue_ids", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m') END AS issue FROM orders")
    def file_issue_ids(spark, sf_dir):
        rules = [titles.NameRule(r"paper_(\d{4})(\d{2})(\d{2})\.pdf$", "{1}{2}{3}"), titles.NameRule(r"^(\d{4}) no\.(\d{1,2})\.pdf$", "{1}{2:02}")]
        day = F.col("o_orderdate")
        name = _case("o_orderkey", F.concat(F.lit("paper_"), F.date_format(day, "yyyyMMdd"), F.lit(".pdf")), F.concat(F.year(day), F.lit(" no."), F.month(day), F.lit(".pdf")), F.lit("cover.pdf"))
        return table(spark, sf_dir, "orders").select("o_orderkey", titles.issue_id(name, rules).alias("issue"))

    @r.query("file_authors", "SELECT c_custkey, c_mktsegment AS author FROM customer")
    def file_authors(spark, sf_dir):
        name = F.concat(F.lit("Book ("), F.col("c_mktsegment"), F.lit(") (Some Library) (2001).epub"))
        return table(spark, sf_dir, "customer").select("c_custkey", text.author_in_name(name).alias("author"))

    @r.query("chosen_titles", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_brand ELSE p_name END AS title FROM part")
    def chosen_titles(spark, sf_dir):
        package = _case("p_partkey", F.lit(None).cast("string"), F.substring("p_name", 1, 3), F.col("p_brand"))
        return table(spark, sf_dir, "part").select("p_partkey", text.chosen_title(package, F.col("p_name")).alias("title"))

    @r.query(
        "seed_codes",
        """WITH h AS (SELECT c_custkey, sha256(c_name) AS h FROM customer) SELECT c_custkey, array_to_string(list_transform(range(8), lambda i: substr('ABCDEFGHJKLMNPQRSTUVWXYZ23456789',
           ((strpos('0123456789abcdef', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 * i + 2, 1)) - 1) % 32 + 1, 1)), '') AS code FROM h""",
    )
    def seed_codes(spark, sf_dir):
        return table(spark, sf_dir, "customer").select("c_custkey", text.code_from_seed(F.col("c_name")).alias("code"))

    @r.query("canonical_urls", "SELECT page_id, regexp_replace(url, '^http://', 'https://') AS url FROM pages")
    def canonical_urls(spark, sf_dir):
        bare = F.regexp_replace("url", "^https?:", "")
        told = _case("page_id", F.concat(F.lit("https://archive.example.org/web/20200102030405id_/"), F.col("url")), F.replace("url", F.lit("&"), F.lit("&amp;")), F.concat(F.lit("  "), bare, F.lit(" ")))
        return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(told).alias("url"))

    @r.query("srcset_lists", "SELECT page_id, url || ';' || url || 'b' AS urls FROM pages")
    def srcset_lists(spark, sf_dir):
        srcset = F.concat(F.col("url"), F.lit(" 1x,  "), F.col("url"), F.lit("b 2x, "))
        return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.srcset_urls(srcset), ";").alias("urls"))

    @r.query("image_sizes", "SELECT p_partkey, w AS width, CAST(w * 3 / 4 AS INT) AS height FROM part, (VALUES (320), (640), (1280)) v(w) WHERE w <= p_size * 40")
    def image_sizes(spark, sf_dir):
        p = table(spark, sf_dir, "part")
        sized = p.select("p_partkey", F.explode(text.image_widths(F.col("p_size") * 40, F.col("p_size") * 30, (320, 640, 1280))).alias("s"))
        return sized.select("p_partkey", "s.width", "s.height")

    @r.query("supplements", "SELECT p_partkey, CASE WHEN p_partkey % 120 > 90 THEN 'supplement ' || p_partkey % 120 % 90 ELSE 'no. ' || p_partkey % 120 END AS label FROM part")
    def supplements(spark, sf_dir):
        return table(spark, sf_dir, "part").select("p_partkey", text.supplement(F.col("p_partkey") % 120).alias("label"))

    @r.query("markdown_cells", r"SELECT p_partkey, p_name || '\|' || p_type || ' ' || p_brand AS cell FROM part")
    def markdown_cells(spark, sf_dir):
        return table(spark, sf_dir, "part").select("p_partkey", text.markdown_cell(F.concat(F.concat_ws("|", "p_name", "p_type"), F.lit("\n"), "p_brand")).alias("cell"))

    @r.query("resolved_paths", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'OEBPS/img/' || p_partkey || '.png' WHEN 2 THEN 'OEBPS/text/' || p_partkey || '.png' END AS path FROM part")
    def resolved_paths(spark, sf_dir):
        name = F.concat(F.col("p_partkey").cast("string"), F.lit(".png"))
        path = _case("p_partkey", F.concat(F.lit("../img/"), name), F.concat(F.lit("../../../"), name), name, F.concat(F.lit("/etc/"), name))
        return table(spark, sf_dir, "part").select("p_partkey", text.resolve_path(F.lit("OEBPS/text/a.xhtml"), path).alias("path"))

    @r.query("isbns", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '9787' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS isbn FROM part")
    def isbns(spark, sf_dir):
        number = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
        told = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("urn:isbn:978-7-"), number)).otherwise(F.concat(F.lit("uuid:"), F.substring(number, 1, 5)))
        return table(spark, sf_dir, "part").select("p_partkey", text.isbn(told).alias("isbn"))

    @r.query("order_times", "SELECT o_orderkey, o_orderdate AS at, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d') AS compact FROM orders")
    def order_times(spark, sf_dir):
        d = F.col("o_orderdate").cast("timestamp")
        at = F.when(F.col("o_orderkey") % 2 == 0, F.unix_millis(d).cast("string")).otherwise(d.cast("string"))
        return table(spark, sf_dir, "orders").select("o_orderkey", dates.iso_time(at).cast("timestamp_ntz").alias("at"), dates.date_prefix(d.cast("string")).alias("day"), dates.compact_date(F.date_format(d, "yyyyMMdd")).alias("compact"))

    @r.query("zoned_times", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS told, CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 7 DAY END AS expires FROM events")
    def zoned_times(spark, sf_dir):
        ts = F.col("ts").cast("timestamp_ntz")
        local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), ts)
        return table(spark, sf_dir, "events").select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm").alias("told"), (F.when(F.col("event_id") % 3 > 0, ts) + F.expr("INTERVAL 7 DAYS")).alias("expires"))

    @r.query("repair_ids", """SELECT c_custkey, 'repair-' || substr(sha256('{"key":' || c_custkey || ',"name":"' || c_name || '"}'), 1, 40) AS id FROM customer""")
    def repair_ids(spark, sf_dir):
        return table(spark, sf_dir, "customer").select("c_custkey", hashing.canonical_hash("repair-", 40, name=F.col("c_name"), key=F.col("c_custkey"), note=F.lit(None).cast("string")).alias("id"))

    @r.query("anchor_keys", """SELECT c_custkey, sha256('["' || c_custkey || '","' || c_name || '"]') AS key FROM customer""")
    def anchor_keys(spark, sf_dir):
        return table(spark, sf_dir, "customer").select("c_custkey", text.anchor_key(F.col("c_custkey"), F.col("c_name")).alias("key"))

    @r.query("media_types", f"SELECT page_id, CASE page_id % {len(MAGIC)} {' '.join(f'''WHEN {i} THEN '{kind}' ''' for i, (_, kind) in enumerate(MAGIC) if kind)} END AS kind FROM pages")
    def media_types(spark, sf_dir):
        data = F.concat(_case("page_id", *[F.unhex(F.lit(head)) for head, _ in MAGIC]), F.col("url").cast("binary"))
        return table(spark, sf_dir, "pages").select("page_id", codecs.media_type(F.substring(data, 1, 12)).alias("kind"))

    @r.query("palmdoc_texts", "SELECT p_partkey, p_name || ' x' || left(p_name, 3) || 'é' AS plain FROM part")
    def palmdoc_texts(spark, sf_dir):
        n = F.length("p_name") + 2
        byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("bigint")), 2, "0"))
        pair = F.unhex(F.lpad(F.hex((n * 8 + 0x8000).cast("bigint")), 4, "0"))
        data = F.concat(F.col("p_name").cast("binary"), byte(F.lit(ord("x") | 0x80)), pair, byte(F.lit(2)), F.lit("é").cast("binary"))
        return table(spark, sf_dir, "part").select("p_partkey", codecs.palmdoc_decompressed(data).cast("string").alias("plain"))

    @r.query("rates", "SELECT CASE WHEN l_discount = 0 THEN '—' ELSE printf('%.1f%%', l_discount * 100) END AS told, least(0.08, greatest(0.02, l_discount)) AS held, count(*) AS n FROM lineitem GROUP BY 1, 2")
    def rates(spark, sf_dir):
        shown = F.when(F.col("l_discount") != 0, F.col("l_discount"))
        return table(spark, sf_dir, "lineitem").groupBy(codecs.percent_text(shown).alias("told"), codecs.clamp(F.col("l_discount"), 0.02, 0.08).alias("held")).agg(F.count(F.lit(1)).alias("n"))

    @r.query(
        "boxes",
        "SELECT l_orderkey, l_linenumber, l_quantity AS x, coalesce(t, 0.0) AS y, greatest(30 - l_quantity, 0.0) AS width, greatest(l_tax - coalesce(t, 0.0), 0.0) AS height FROM (SELECT *, CASE WHEN l_linenumber > 1 THEN l_discount END AS t FROM lineitem)",
    )
    def boxes(spark, sf_dir):
        box = codecs.box(F.col("l_quantity"), F.when(F.col("l_linenumber") > 1, F.col("l_discount")), F.lit(30.0), F.col("l_tax"))
        return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")

    @r.query("source_pages", "SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size + 7 WHEN 1 THEN p_size + 1 + 7 ELSE 8 END AS INT) AS page FROM part")
    def source_pages(spark, sf_dir):
        none = F.lit(None).cast("int")
        page = text.source_page(_case("p_partkey", F.col("p_size"), F.lit(0), none), _case("p_partkey", F.lit(99), F.col("p_size"), none), F.lit(7))
        return table(spark, sf_dir, "part").select("p_partkey", page.cast("int").alias("page"))

    @r.query("missing_assets", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '<p>a</p><p></p>' ELSE '<p>a</p><figure data-asset=\"x1\"><img></figure><p><span class=\"s\" data-asset=\"x2\">b</span></p>' END AS html FROM part")
    def missing_assets(spark, sf_dir):
        whole = F.lit('<p>a</p><figure data-asset="x1"><img></figure><p><span class="s" data-asset="x2">b</span></p>')
        gone = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("x1"), F.lit("x2"))).otherwise(F.array(F.lit("y")))
        return table(spark, sf_dir, "part").select("p_partkey", text.without_assets(whole, gone).alias("html"))

    @r.query("item_ids", "SELECT p_partkey, p_brand || ':' || p_name AS id FROM part")
    def item_ids(spark, sf_dir):
        return table(spark, sf_dir, "part").select("p_partkey", text.item_id(F.col("p_brand"), F.col("p_name")).alias("id"))

    @r.query("daily_picks", "SELECT o_orderkey, CAST((CAST(o_orderdate AS DATE) - DATE '1970-01-01') % 7 AS INT) AS pick FROM orders")
    def daily_picks(spark, sf_dir):
        return table(spark, sf_dir, "orders").select("o_orderkey", calendar.daily_pick(F.to_date("o_orderdate"), 7).alias("pick"))

    @r.query("issue_id_validity", "SELECT o_orderkey, o_orderkey % 4 < 2 AS ok FROM orders")
    def issue_id_validity(spark, sf_dir):
        issue = _case("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd"), F.date_format("o_orderdate", "yyyyMM"), F.lit("19991332"), F.lit("1999-01"))
        return table(spark, sf_dir, "orders").select("o_orderkey", calendar.is_issue_id(issue).alias("ok"))

    @r.query("local_paths", "SELECT page_id, page_id % 5 = 0 AS ok FROM pages")
    def local_paths(spark, sf_dir):
        path = _case("page_id", F.lit("/read?x=1"), F.lit("//evil.example.org"), F.lit("/a\\b"), F.col("url"), F.rpad(F.lit("/"), 1025, "a"))
        return table(spark, sf_dir, "pages").select("page_id", text.local_path(path).alias("ok"))

    @r.query("permitted_assets", "SELECT page_id, page_id % 5 IN (0, 1, 2) AS ok FROM pages")
    def permitted_assets(spark, sf_dir):
        url = _case("page_id", F.lit("data:image/png;base64,AAAA"), F.lit("https://cdn.example.org/x.png"), F.lit("https://example.org/y"), F.lit("http://cdn.example.org/x.png"), F.lit("https://badexample.org/x"))
        return table(spark, sf_dir, "pages").select("page_id", items.permitted_asset(url, ["example.org"]).alias("ok"))

    @r.query(
        "page_completion",
        "WITH c AS (SELECT page_id, length(html) AS n, CAST(page_id % 4 AS INT) AS refs, CAST(page_id % 3 AS INT) AS got FROM pages), s AS (SELECT *, CASE WHEN refs = 0 THEN 'none' WHEN got >= refs THEN 'complete' WHEN got > 0 THEN 'partial' ELSE 'missing' END AS images FROM c) SELECT page_id, images, CASE WHEN n >= 2000 AND images IN ('complete', 'none') THEN 'complete' ELSE 'partial' END AS state FROM s",
    )
    def page_completion(spark, sf_dir):
        images = crawl.image_status(F.col("page_id") % 4, F.col("page_id") % 3)
        return table(spark, sf_dir, "pages").select("page_id", images.alias("images"), crawl.completion(F.length("html"), images, 2000).alias("state"))

    @r.query("page_windows", "SELECT p_partkey, CASE p_size WHEN 1 THEN '1' WHEN 2 THEN '1 2' WHEN 3 THEN '1 2 3' WHEN 4 THEN '1 2 3 4' ELSE CASE WHEN p_size > 4 THEN '1 2 3 … ' || p_size END END AS shown FROM part")
    def page_windows(spark, sf_dir):
        return tables.page_numbers(table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("at"), F.col("p_size").alias("n")), "at", "n").select("p_partkey", "shown")

    @r.query("clean_documents", """SELECT doc_id, md5('{"title":"' || source || '","page":"' || n_chars || '"}') AS digest FROM documents""")
    def clean_documents(spark, sf_dir):
        d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.lit("").alias("content"), F.lit(None).cast("string").alias("date"), F.col("n_chars").alias("page"), F.lit("x").alias("secret"))
        return d.select("doc_id", F.md5(tables.clean_document(d)).alias("digest"))

    @r.query(
        "flag_rule_errors",
        "SELECT c_custkey AS key, unnest(CASE c_custkey % 5 WHEN 1 THEN ['fallback'] WHEN 2 THEN ['percentage'] WHEN 3 THEN ['duplicate_id'] WHEN 4 THEN ['name', 'users'] ELSE [] END) AS code FROM customer",
    )
    def flag_rule_errors(spark, sf_dir):
        key, none = F.col("c_custkey") % 5, F.lit(None).cast("timestamp")

        def rule(id_, name, kind, percentage, users, fallback):
            return F.struct(id_.alias("id"), name.alias("name"), F.lit(True).alias("enabled"), F.lit(kind).alias("conditionType"), percentage.alias("percentage"), users.alias("userIds"), none.alias("startsAt"), none.alias("endsAt"), fallback.alias("isFallback"))

        no_users = F.array().cast("array<string>")
        some = F.when(key == 4, no_users).otherwise(F.array(F.lit("u")))
        rules = F.array(
            rule(F.lit("a"), F.when(key == 4, F.lit(" ")).otherwise(F.lit("some")), "users", F.lit(None).cast("int"), some, F.lit(False)),
            rule(F.when(key == 3, F.lit("a")).otherwise(F.lit("b")), F.lit("part"), "percentage", F.when(key == 2, 0).otherwise(50), no_users, F.lit(False)),
            rule(F.lit("c"), F.lit("rest"), "global", F.lit(None).cast("int"), no_users, key != 1),
        )
        return flags.rule_errors(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), rules.alias("rules")))
