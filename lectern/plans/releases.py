"""Queries of releases: snapshots that are refreshed by part, their documents, and the checks of a whole release."""

from __future__ import annotations

import contextlib
import sqlite3
import tempfile

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.functions import readings
from lectern.operators import assign, validation
from lectern.registry import Registry, table
from lectern.session import shared_folder
from lectern.sources import places, snapshot, sqlite


def register(r: Registry) -> None:
    @r.query(
        "snapshot_refresh",
        """WITH o AS (SELECT o_orderstatus, o_orderpriority AS part, o_orderkey, o_totalprice FROM orders), n AS (SELECT part, count(*) AS n FROM o WHERE part <> '5-LOW' GROUP BY 1)
           SELECT part, CASE part WHEN '2-HIGH' THEN 'written' ELSE 'kept' END AS state, n FROM n UNION ALL SELECT '5-LOW', 'removed', count(*) FROM o WHERE part = '5-LOW'""",
    )
    def snapshot_refresh(spark, sf_dir):
        at, o = shared_folder(spark, "snapshot"), table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
        snapshot.refresh(o, at, "o_orderpriority")
        changed = o.where("o_orderpriority <> '5-LOW'").withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "2-HIGH", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")))
        return snapshot.refresh(changed, at, "o_orderpriority")

    @r.query("snapshot_rows", "SELECT p_brand, p_partkey, CASE WHEN p_brand = 'Brand#3' THEN p_size + 1 ELSE p_size END AS p_size FROM part")
    def snapshot_rows(spark, sf_dir):
        at, p = shared_folder(spark, "snapshot"), table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
        snapshot.refresh(p, at, "p_brand")
        snapshot.refresh(p.withColumn("p_size", F.col("p_size") + (F.col("p_brand") == "Brand#3").cast("int")), at, "p_brand")
        return snapshot.current(spark, at, "p_brand").select("p_brand", "p_partkey", "p_size")

    @r.query(
        "collection_documents",
        r"""WITH s AS (SELECT source, 'collections/' || source AS folder FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
            i AS (SELECT source, lang, count(*) AS n, string_agg('- Text ' || doc_id, chr(10) ORDER BY doc_id) AS toc FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2),
            t AS (SELECT source, count(*) AS items, string_agg('| Lang ' || lang || ' | ' || n || ' | [查看](items/' || lang || '.md) | [JSON.GZ](items/' || lang || '.json.gz) |', chr(10) ORDER BY 'Lang ' || lang) AS rows FROM i GROUP BY 1)
            SELECT source AS dataset, folder || '/items/' || lang || '.md' AS path, sha256('# Lang ' || lang || chr(10) || chr(10) || '- 作者：A' || chr(10) || '- 出版社：未注明' || chr(10) || '- 章节数：' || n || chr(10) || '- 图片/媒体：0' || chr(10) || '- 注释：0' || chr(10)
              || '- [查看结构化目录](' || lang || '.toc.json)' || chr(10) || '- [下载完整 Canonical Item](' || lang || '.json.gz)' || chr(10) || chr(10) || '## 目录' || chr(10) || chr(10) || toc || chr(10)) AS digest FROM i JOIN s USING (source)
            UNION ALL SELECT source, folder || '/README.md', sha256('# ' || source || chr(10) || chr(10) || 'd' || chr(10) || chr(10) || '- 类型：`book`' || chr(10) || '- 语言：`en`' || chr(10) || '- 卷册/Item：' || coalesce(items, 0) || chr(10) || chr(10) || '## 卷册' || chr(10) || chr(10)
              || '| 名称 | 章节 | 在线目录 | 完整下载 |' || chr(10) || '|---|---:|---|---|' || chr(10) || coalesce(rows || chr(10), '')) FROM s LEFT JOIN t USING (source)""",
    )
    def collection_documents(spark, sf_dir):
        d = table(spark, sf_dir, "documents").where("source IS NOT NULL")
        datasets = d.select(F.col("source").alias("dataset")).distinct().select("dataset", F.col("dataset").alias("title"), F.lit("book").alias("type"), F.lit("en").alias("language"), F.lit("d").alias("description"))
        c = d.where("lang IS NOT NULL").select(F.col("source").alias("dataset"), F.col("lang").alias("item_key"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("int").alias("order"), F.concat(F.lit("Text "), "doc_id").alias("title"))
        items = c.select("dataset", "item_key").distinct().select(
            "dataset", "item_key", F.concat("dataset", F.lit(":"), "item_key").alias("item_id"), F.concat(F.lit("Lang "), "item_key").alias("title"), F.lit("book").alias("type"), F.lit(1).alias("order"), F.array(F.lit("A")).alias("authors"), F.lit("").alias("publisher"), F.lit(0).alias("assets"), F.lit(0).alias("annotations")
        )
        out = snapshot.collection_documents(datasets, items, c)
        return out.where("path NOT LIKE '%.json'").select("dataset", "path", F.sha2("content", 256).alias("digest"))

    @r.query(
        "release_checks",
        """SELECT 'dataset' AS kind, n_name AS object, 'dataset id differs' AS error FROM nation WHERE n_regionkey = 3
           UNION ALL SELECT 'item', 'm' || c_custkey, 'item id differs' FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'item', 'm' || c_custkey, 'item is not in the report' FROM customer WHERE NOT c_acctbal > 0
           UNION ALL SELECT 'fragment', 'f' || doc_id, 'size differs' FROM documents WHERE octet_length(encode(coalesce(text, ''))) <> n_chars OR n_chars IS NULL
           UNION ALL SELECT 'fragment', 'f' || doc_id, 'digest differs' FROM documents WHERE text IS NULL UNION ALL SELECT 'fragment', 'f' || doc_id, 'identity differs' FROM documents WHERE NOT coalesce(lang = 'en', false)
           UNION ALL SELECT 'document', 'm' || o_custkey, 'manifest does not exist' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'document', 'm' || o_custkey, 'fragment does not exist' FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM documents)""",
    )
    def release_checks(spark, sf_dir):
        t = lambda name: table(spark, sf_dir, name)
        named = lambda front, c: F.concat(F.lit(front), F.col(c).cast("string"))
        datasets = t("nation").select(F.col("n_nationkey").alias("dataset"), F.when(F.col("n_regionkey") != 3, F.col("n_nationkey")).alias("index_dataset"), F.col("n_name").alias("object"))
        items = t("customer").select(F.col("c_nationkey").alias("dataset"), F.col("c_custkey").alias("item_id"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey")).alias("manifest_item"), named("m", "c_custkey").alias("object"), (F.col("c_acctbal") > 0).alias("in_report"))
        identity = F.when(F.col("lang") == "en", F.col("doc_id"))
        fragments = t("documents").select(
            named("f", "doc_id").alias("object"), F.lit("chapter").alias("kind"), F.col("doc_id").alias("item_id"), F.col("doc_id").alias("manifest_item"), F.col("doc_id").alias("chapter_id"), identity.alias("fragment_id"),
            F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"), F.col("text").cast("binary").alias("content"), F.lit(None).cast("bigint").alias("toc_target"),
        )
        documents = t("orders").select(named("m", "o_custkey").alias("manifest_object"), named("f", "o_orderkey").alias("fragment_object"))
        at = shared_folder(spark, "errors")
        validation.validate(validation.checked(datasets, items, fragments, documents), at, {})
        return spark.read.schema("kind string, object string, error string").parquet(at)

    @r.query("sqlite_rows", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 1000.5 AND c_nationkey IN (1, 2, 3)")
    def sqlite_rows(spark, sf_dir):
        at = shared_folder(spark, "sqlite")

        def store(key: tuple, rows: pa.Table) -> pa.Table:
            # a database is made in a folder of the task's own and then put where all see it
            with tempfile.TemporaryDirectory() as own:
                with contextlib.closing(sqlite3.connect(f"{own}/t.db")) as db:
                    db.execute("CREATE TABLE customer (c_custkey INTEGER PRIMARY KEY, c_name TEXT, c_nationkey INT, c_acctbal REAL)")
                    db.executemany("INSERT INTO customer VALUES (?, ?, ?, ?)", zip(*(rows[c].to_pylist() for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal")), strict=True))
                    db.commit()
                with open(f"{own}/t.db", "rb") as f:
                    places.put(f"{at}/{key[0].as_py()}.db", f.read())
            return pa.table({"part": pa.array([key[0].as_py()], pa.int64())})

        c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.expr("c_custkey div 40000 * 4 + c_custkey % 4").alias("part"))
        c.groupBy("part").applyInArrow(store, "part long").write.format("noop").mode("overwrite").save()
        return sqlite.table(spark, at, "customer", rows=200).where("c_acctbal > 1000.5 AND c_nationkey IN (1, 2, 3)")

    @r.query(
        "title_ids",
        """WITH p AS (SELECT p_partkey, p_name || ' 重庆' AS title, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')) || '-chong-qing' AS slug FROM part)
           SELECT p_partkey, CASE WHEN length(slug) <= 80 THEN slug ELSE regexp_replace(substr(slug, 1, 71), '-+$', '') || '-' || substr(sha256(title), 1, 8) END AS id FROM p""",
    )
    def title_ids(spark, sf_dir):
        given = spark.createDataFrame([("重", "zhong", 1), ("重庆", "chong qing", 1), ("庆", "qing", 1)], "phrase string, reading string, rank int")
        return table(spark, sf_dir, "part").select("p_partkey", readings.title_ids(given)(F.concat("p_name", F.lit(" 重庆"))).alias("id"))

    # a recursion in SQL takes minutes on the whole table: tested against brute force
    @r.query("dealt_in_turn")
    def dealt_in_turn(spark, sf_dir):
        c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("group"), (F.col("c_custkey") % 400).cast("string").alias("name"))
        return assign.deal_in_turn(c, "group", "name")
