"""Queries of readers and writers: what a writer puts into the shared folder, its reader gives back."""

from __future__ import annotations

import gzip
import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lectern.functions import codecs
from lectern.registry import Registry, table
from lectern.session import dealt, shared_folder
from lectern.sources import readers, sinks

ARTICLE = r"(?s)^# (.*?)\n\ndate: (.*?)\npage: (.*?)\n\n(.*)$"


@F.arrow_udf(BinaryType())
def _stored(value: pa.Array, key: pa.Array) -> pa.Array:
    return pa.array([sinks.masked_object(json.loads(v), k)[0] for v, k in zip(value.to_pylist(), key.to_pylist(), strict=True)], pa.binary())


@F.arrow_udf(BinaryType())
def _opened(data: pa.Array, key: pa.Array) -> pa.Array:
    return pa.array([gzip.decompress(codecs.mask(d, k)) for d, k in zip(data.to_pylist(), key.to_pylist(), strict=True)], pa.binary())


def register(r: Registry) -> None:
    @r.query("search_documents_file", "SELECT CAST(doc_id AS VARCHAR) AS \"documentId\", source AS \"datasetId\", CAST(n_chars AS INT) AS ord, md5(text) AS digest FROM documents")
    def search_documents_file(spark, sf_dir):
        at = shared_folder(spark, "jsonl")
        d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("documentId"), F.col("source").alias("datasetId"), F.col("n_chars").cast("int").alias("ord"), "text")
        sinks.json_lines(d, at)
        return readers.json_lines(spark, at).select("documentId", "datasetId", "ord", F.md5("text").alias("digest"))

    def manifest(spark, sf_dir):
        at, k = shared_folder(spark, "manifest"), F.col("page_id") % 4
        p = table(spark, sf_dir, "pages").select("url", F.when(k == 1, "").when(k == 2, "news").alias("section"), F.when(k == 3, "missing").otherwise("found").alias("wayback_status"), F.lit("20200101").alias("wayback_timestamp"))
        sinks.json_lines(p, at)
        return readers.crawl_manifest(spark, at)

    @r.query("crawl_manifest", "SELECT url, CASE WHEN page_id % 4 = 2 THEN 'news' ELSE 'unknown' END AS section FROM pages WHERE page_id % 4 <> 3")
    def crawl_manifest(spark, sf_dir):
        return manifest(spark, sf_dir)[0].select("url", "section")

    @r.query("crawl_manifest_counts", "SELECT count(CASE WHEN page_id % 4 <> 3 THEN 1 END) AS downloadable, count(CASE WHEN page_id % 4 = 3 THEN 1 END) AS skipped FROM pages")
    def crawl_manifest_counts(spark, sf_dir):
        return manifest(spark, sf_dir)[1]

    @r.query("articles_file_tree", "SELECT page_id, url AS title, '1997-01-15' AS date, CASE WHEN page_id % 2 = 0 THEN 0 ELSE CAST(page_id AS INT) END AS page, md5('text ' || page_id || chr(10)) AS digest, 'ns:k=' || page_id AS folder FROM pages")
    def articles_file_tree(spark, sf_dir):
        at = shared_folder(spark, "articles")
        body = F.format_string("# %s\n\ndate: 1997-01-15\npage: %s\n\ntext %s", "url", F.when(F.col("page_id") % 2 == 0, "").otherwise(F.col("page_id").cast("string")), F.col("page_id").cast("string"))
        pages = dealt(table(spark, sf_dir, "pages").select("page_id", "url")).select(F.col("page_id").alias("k"), body.alias("value"))
        sinks.text_files(pages, at, "k", "value")
        a = readers.markdown_articles(spark, at, "ns", ARTICLE, "*.txt")
        folder = F.regexp_replace("logical_id", "/[^/]*$", "")
        return a.select(F.regexp_extract("path", "k=([0-9]+)/", 1).cast("bigint").alias("page_id"), "title", "date", "page", F.md5("content").alias("digest"), folder.alias("folder"))

    @r.query("listed_files", "SELECT CAST(count(DISTINCT source) AS BIGINT) AS folders, true AS filled FROM documents")
    def listed_files(spark, sf_dir):
        at = shared_folder(spark, "listed")
        table(spark, sf_dir, "documents").select("source", "doc_id").repartition("source").write.partitionBy("source").parquet(at)
        found = readers.files(spark, at, "*.parquet")
        return found.agg(F.count_distinct(F.regexp_extract("path", "source=([^/]*)/", 1)).alias("folders"), F.bool_and(F.col("size") > 0).alias("filled"))

    @r.query("issue_files", "SELECT DISTINCT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y%m%d') AS issue FROM orders WHERE o_orderkey % 3 < 2")
    def issue_files(spark, sf_dir):
        y, day = F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "yyyyMMdd")
        bad = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("1801/"), day, F.lit(".pdf"))).otherwise(F.concat(y, F.lit("/cover.pdf")))
        paths = table(spark, sf_dir, "orders").select(F.concat(F.lit("/archive/"), F.when(F.col("o_orderkey") % 3 < 2, F.concat(y, F.lit("/"), day, F.lit(".pdf"))).otherwise(bad)).alias("path"))
        return readers.issues(paths)

    @r.query("taxonomy_file", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS kind FROM part")
    def taxonomy_file(spark, sf_dir):
        at = shared_folder(spark, "taxonomy")
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind")).write.option("sep", "\t").option("header", True).option("quote", "").csv(at)
        return readers.taxonomy(spark, at)

    @r.query("masked_objects", "SELECT c_custkey, c_name, sha256('{\"key\":' || c_custkey || ',\"name\":\"' || c_name || '\"}') AS clear FROM customer")
    def masked_objects(spark, sf_dir):
        value = F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")))
        key = F.concat(F.lit("objects/"), F.col("c_custkey").cast("string"), F.lit(".jox"))
        stored = table(spark, sf_dir, "customer").select("c_custkey", key.alias("at"), _stored(value, key).alias("data"))
        clear = stored.select("c_custkey", _opened("data", F.concat(F.lit("/"), F.col("at"))).cast("string").alias("clear"))
        return clear.select("c_custkey", F.get_json_object("clear", "$.name").alias("c_name"), F.sha2("clear", 256).alias("clear"))

    @r.query("asset_cache", "SELECT c_name AS url, 'order/' || max(o_orderkey) AS path FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_name")
    def asset_cache(spark, sf_dir):
        o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        asset = lambda url, path: F.struct(url.alias("sourceUrl"), path.alias("path"))
        path = F.concat(F.lit("order/"), F.col("o_orderkey").cast("string"))
        return readers.asset_cache(o.select(F.col("o_orderkey").alias("seq"), F.array(asset(F.col("c_name"), F.lit("older")), asset(F.col("c_name"), path), asset(F.lit(""), path), asset(F.col("c_name"), F.lit(""))).alias("assets")))

    @r.query("page_lists", "SELECT page_id, CAST(page_id % 3 AS INT) AS n_pages, CASE WHEN page_id % 2 = 0 THEN '/attachement/' || page_id || '.pdf' END AS pdf FROM pages")
    def page_lists(spark, sf_dir):
        links = F.repeat(F.lit('<a class="x" id="pageLink">1</a>'), (F.col("page_id") % 3).cast("int"))
        pdf = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<a href="/attachement/'), F.col("page_id").cast("string"), F.lit('.pdf">a</a><a href="/attachement/z.pdf">'))).otherwise('<a href="/other/z.pdf">')
        return readers.page_links(table(spark, sf_dir, "pages").select("page_id", F.concat(links, pdf).alias("html")), "html").drop("html")

    @r.query(
        "feed_entries",
        """SELECT page_id, sha1(url) AS id, 'T & ' || page_id AS title, url, 'S ' || page_id AS summary, TIMESTAMP '2024-01-02 03:04:05' AS published FROM pages WHERE page_id % 3 < 2""",
    )
    def feed_entries(spark, sf_dir):
        k, url = F.col("page_id").cast("string"), F.replace("url", F.lit("&"), F.lit("&amp;"))
        rss = F.format_string('<rss><channel><item><title>T &amp;amp; &lt;b&gt;%s&lt;/b&gt;</title><link>%s</link><description>&lt;p&gt;S %s&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><link>no title</link></item></channel></rss>', k, url, k)
        atom = F.format_string('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T &amp;amp; %s</title><link href="%s"/><content>S  %s</content><updated>2024-01-02T03:04:05Z</updated></entry></feed>', k, url, k)
        body = F.when(F.col("page_id") % 3 == 0, rss).when(F.col("page_id") % 3 == 1, atom).otherwise("<html><item><title>x</title></item></html>")
        items = readers.feed_items(table(spark, sf_dir, "pages").select("page_id", body.alias("body")), "body")
        return items.select("page_id", "id", "title", "url", "summary", F.col("published").cast("timestamp_ntz").alias("published"))

    @r.query("source_list_errors", "SELECT 'version' AS code, c_custkey AS id FROM customer WHERE c_custkey % 4 = 1 UNION ALL SELECT 'blank', c_custkey FROM customer WHERE c_custkey % 4 = 2 UNION ALL SELECT 'route', c_custkey FROM customer WHERE c_custkey % 4 = 3")
    def source_list_errors(spark, sf_dir):
        k = F.col("c_custkey") % 4
        s = table(spark, sf_dir, "customer").select(F.when(k == 1, 2).otherwise(1).alias("version"), F.col("c_custkey").alias("id"), F.when(k == 2, " ").otherwise(F.col("c_name")).alias("name"), F.lit("en").alias("language"), F.when(k == 3, "feed").otherwise("/feed").alias("route"), F.lit(None).cast("boolean").alias("enabled"))
        return readers.source_list_errors(s)

    @r.query("stored_objects", "SELECT DISTINCT 'objects/page/' || substr(sha256(p_name), 1, 2) || '/' || sha256(p_name) || '.txt.gz' AS name, CAST(octet_length(encode(p_name)) AS BIGINT) AS size, sha256(p_name) AS sha256 FROM part")
    def stored_objects(spark, sf_dir):
        p = table(spark, sf_dir, "part").select(F.col("p_name").cast("binary").alias("c"))
        return sinks.store_objects(p, "c", "page", "txt", lambda name, data: None, compress=True)

    @r.query("bulk_sent", "SELECT count(*) AS sent FROM orders")
    def bulk_sent(spark, sf_dir):
        def send(rows):
            return [] if len(rows) <= 500 else ["too many"]

        return sinks.bulk(table(spark, sf_dir, "orders").select("o_orderkey"), send)

    @r.query("replaced_scope", "SELECT o_orderstatus, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END) AS BIGINT) AS keys FROM orders GROUP BY 1")
    def replaced_scope(spark, sf_dir):
        at = shared_folder(spark, "scope")
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
        sinks.replace_scope(o, at, "o_orderstatus")
        sinks.replace_scope(o.where("o_orderstatus = 'P'").withColumn("o_orderkey", -F.col("o_orderkey")), at, "o_orderstatus")
        return spark.read.parquet(at).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))

    @r.query("csv_report", "SELECT hex(encode(chr(65279) || 'n_nationkey,n_name')) AS head, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
    def csv_report(spark, sf_dir):
        at = shared_folder(spark, "report")
        sinks.csv_report(table(spark, sf_dir, "nation"), at, ["n_nationkey", "n_name"])
        lines = spark.read.format("binaryFile").load(f"{at}/*.csv").select(F.split(F.col("content").cast("string"), "\n").alias("l"))
        cells = lines.select(F.hex(F.get("l", F.lit(0)).cast("binary")).alias("head"), F.explode(F.filter(F.slice("l", 2, 1 << 20), lambda x: x != "")).alias("x")).select("head", F.split("x", ",").alias("c"))
        return cells.select("head", F.get("c", F.lit(0)).alias("n_nationkey"), F.get("c", F.lit(1)).alias("n_name"))

    @r.query("json_report", "SELECT n_nationkey, CASE WHEN n_regionkey <> 1 THEN n_name END AS n_name, n_regionkey = 1 AS told FROM nation")
    def json_report(spark, sf_dir):
        at = shared_folder(spark, "report")
        n = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("n_name"))
        sinks.json_report(n, at, ["n_nationkey", "n_name"])
        lines = spark.read.text(at)
        return lines.select(F.from_json("value", "n_nationkey int, n_name string").alias("r"), F.contains("value", F.lit('"n_name":null')).alias("told")).select("r.*", "told")

    @r.query("report_markdown", r"SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || CASE WHEN r_regionkey = 2 THEN '—' ELSE r_name || '\|' END || ' |', chr(10) ORDER BY r_regionkey) AS markdown FROM region")
    def report_markdown(spark, sf_dir):
        rows = table(spark, sf_dir, "region").select("r_regionkey", F.when(F.col("r_regionkey") != 2, F.concat("r_name", F.lit("|"))).alias("r_name"))
        return sinks.markdown_table(rows, ["r_regionkey", "r_name"], [F.col("r_regionkey")])

    @r.query(
        "year_manifest",
        """WITH f AS (SELECT DISTINCT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y%m') AS file FROM orders), y AS (SELECT year, '{"year":"' || year || '","files":[' || string_agg('"' || file || '"', ',' ORDER BY file) || ']}' AS j FROM f GROUP BY year)
           SELECT '{"years":[' || string_agg(j, ',' ORDER BY year DESC) || ']}' AS json FROM y""",
    )
    def year_manifest(spark, sf_dir):
        return sinks.year_manifest(table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy").alias("year"), F.date_format("o_orderdate", "yyyyMM").alias("file")))

    @r.query("object_round_trip", "SELECT n_nationkey, n_name FROM nation")
    def object_round_trip(spark, sf_dir):
        at = shared_folder(spark, "objects")
        table(spark, sf_dir, "nation").write.option("compression", "gzip").json(at)
        return spark.read.schema("n_nationkey int, n_name string").json(at)
