"""Snapshots that are rebuilt by part: only parts whose fingerprint changed are written, the catalogue is swapped last.

A snapshot's folder holds ``parts/v=<version>/<part column>=<value>`` and, for each refresh, ``catalogue/<version>``: which version of each part is valid, its
fingerprint and number of rows. ``CURRENT`` names the valid catalogue; it is replaced, in one move, when all else is written, so
that a reader sees the snapshot of before or of after, and a refresh that fails leaves the one of before.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import markdown_cell
from lectern.sources import places

CATALOGUE = "part string, version string, fingerprint string, n long"


def fingerprints(rows: DataFrame, by: str) -> DataFrame:
    """(part, fingerprint, n): what a part's rows are, whatever their order. Rows count as often as they occur.

    A row is the SHA-256 of its columns' names and values as JSON; a part adds up the two halves of 64 bits of its rows' digests, which combines before the shuffle.
    """
    columns = sorted(c for c in rows.columns if c != by)
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substring(row, 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)") for k in (0, 1)]
    sums = rows.select(F.col(by).cast("string").alias("part"), *(h.alias(f"h{k}") for k, h in enumerate(halves))).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1"))
    return sums.select("part", F.sha2(F.concat_ws(":", "n", "h0", "h1", F.lit(",".join(columns))), 256).alias("fingerprint"), "n")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The valid catalogue; empty where there is no snapshot yet."""
    fs, at = places.place(f"{path}/CURRENT")
    if fs.get_file_info(at).type != pafs.FileType.File:
        return spark.createDataFrame([], CATALOGUE)
    with fs.open_input_file(at) as f:
        return spark.read.schema(CATALOGUE).parquet(f"{path}/catalogue/{f.read().decode()}")


def current(spark: SparkSession, path: str, by: str) -> DataFrame:
    """The snapshot's rows. Parts of versions that the catalogue doesn't name are pruned by the join."""
    valid = catalogue(spark, path).select(F.col("version").alias("_v"), F.col("part").alias("_part"))
    parts = spark.read.option("recursiveFileLookup", "false").parquet(f"{path}/parts")
    return parts.join(valid, (parts["v"] == F.col("_v")) & parts[by].cast("string").eqNullSafe(F.col("_part")), "left_semi").drop("v")


def refresh(rows: DataFrame, path: str, by: str) -> DataFrame:
    """Makes the snapshot that of ``rows`` and gives the report (part, state, n): *written*, *kept* or *removed*.

    ``by`` names parts; a null part is one of its own. The rows are read twice, for fingerprints and to write what changed; of a source that is itself
    in folders by ``by``, only those of changed parts are read again. Without changes nothing is written. An empty ``rows`` removes all parts.
    """
    spark, version = rows.sparkSession, uuid.uuid4().hex
    old = catalogue(spark, path)
    new = fingerprints(rows, by)
    both = new.alias("a").join(old.alias("b"), F.expr("a.part <=> b.part"), "full_outer")
    state = F.when(F.col("a.n").isNull(), "removed").when(F.expr("a.fingerprint = b.fingerprint"), "kept").otherwise("written")
    valid = F.when(state == "kept", F.col("b.version")).otherwise(F.lit(version))
    plan = both.select(
        F.when(F.col("a.n").isNull(), F.col("b.part")).otherwise(F.col("a.part")).alias("part"), valid.alias("version"), F.coalesce("a.fingerprint", "b.fingerprint").alias("fingerprint"), F.coalesce("a.n", "b.n").alias("n"), state.alias("state")
    )
    planned = f"{path}/plans/{version}"
    plan.write.parquet(planned)
    plan = spark.read.schema(CATALOGUE + ", state string").parquet(planned)
    report = plan.select("part", "state", "n")
    if plan.where("state <> 'kept'").isEmpty():
        return report
    changed = plan.where("state = 'written'").select(F.col("part").alias("_part"))
    if not changed.isEmpty():
        due = rows.join(changed, rows[by].cast("string").eqNullSafe(F.col("_part")), "left_semi")
        due.write.partitionBy(by).parquet(f"{path}/parts/v={version}")
    plan.where("state <> 'removed'").select("part", "version", "fingerprint", "n").write.parquet(f"{path}/catalogue/{version}")
    places.put(f"{path}/CURRENT", version.encode())
    return report


def collection_documents(datasets: DataFrame, items: DataFrame, chapters: DataFrame) -> DataFrame:
    """(dataset, path, content): the documents of a published collection, to be refreshed by ``dataset``.

    datasets(dataset, title, type, language, description), items(dataset, item_key, item_id, title, type, order, authors, publisher, assets, annotations),
    chapters(dataset, item_key, id, order, title). Each item has a table of contents as JSON and a page, each dataset a page
    with a row for each item. Folders are named by title; datasets of one name behind the first get the last six characters of their id.
    """
    slug = F.regexp_replace(F.regexp_replace(F.col("title"), r"[^\w㐀-鿿-]+", "-"), r"^[ .-]+|[ .-]+$", "")
    slug = F.when(slug == "", F.col("dataset")).otherwise(F.substring(slug, 1, 100))
    again = F.row_number().over(Window.partitionBy("_s").orderBy("dataset")) > 1
    named = datasets.withColumn("_s", slug).withColumn("folder", F.concat(F.lit("collections/"), F.when(again, F.concat("_s", F.lit("-"), F.substring("dataset", -6, 6))).otherwise(F.col("_s")))).drop("_s")
    held = chapters.groupBy("dataset", "item_key").agg(F.array_sort(F.collect_list(F.struct("order", "id", "title"))).alias("_c"))
    whole = items.join(held, ["dataset", "item_key"], "left").join(named.select("dataset", "folder", F.col("title").alias("dataset_title")), "dataset")
    listed = F.coalesce("_c", F.array().cast("array<struct<order:int,id:string,title:string>>"))
    n = F.size(listed).cast("string")
    toc = F.to_json(F.struct("dataset", F.col("dataset_title").alias("datasetTitle"), F.col("item_id").alias("itemId"), F.col("title").alias("itemTitle"), "type", F.size(listed).alias("chapterCount"), F.col("assets").alias("assetCount"), F.col("annotations").alias("annotationCount"), listed.alias("chapters"), F.concat("item_key", F.lit(".json.gz")).alias("download")))
    line = F.concat_ws("\n", F.transform(listed, lambda c: F.concat(F.lit("- "), _cell(c["title"]))))
    authors = F.coalesce(F.nullif(F.array_join("authors", "、"), F.lit("")), F.lit("未注明"))
    page = F.concat_ws(
        "\n", F.concat(F.lit("# "), _cell(F.col("title"))), F.lit(""), F.concat(F.lit("- 作者："), _cell(authors)), F.concat(F.lit("- 出版社："), _cell(F.coalesce(F.nullif("publisher", F.lit("")), F.lit("未注明")))),
        F.concat(F.lit("- 章节数："), n), F.concat(F.lit("- 图片/媒体："), F.coalesce(F.col("assets"), F.lit(0))), F.concat(F.lit("- 注释："), F.coalesce(F.col("annotations"), F.lit(0))),
        F.concat(F.lit("- [查看结构化目录]("), "item_key", F.lit(".toc.json)")), F.concat(F.lit("- [下载完整 Canonical Item]("), "item_key", F.lit(".json.gz)")), F.lit(""), F.lit("## 目录"), F.lit(""), line, F.lit(""),
    )
    at = F.concat("folder", F.lit("/items/"), "item_key")
    files = whole.select("dataset", F.explode(F.array(F.struct(F.concat(at, F.lit(".toc.json")).alias("path"), toc.alias("content")), F.struct(F.concat(at, F.lit(".md")).alias("path"), page.alias("content")))).alias("f")).select("dataset", "f.*")
    cell = F.concat(F.lit("| "), _cell(F.col("title")), F.lit(" | "), n, F.lit(" | [查看](items/"), "item_key", F.lit(".md) | [JSON.GZ](items/"), "item_key", F.lit(".json.gz) |"))
    table = whole.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("order", F.lit(0)).alias("o"), F.coalesce("title", F.lit("")).alias("t"), cell.alias("l")))).alias("_t"))
    rows = F.coalesce(F.transform("_t", lambda t: t["l"]), F.array().cast("array<string>"))
    readme = F.concat_ws(
        "\n", F.concat(F.lit("# "), _cell(F.col("title"))), F.lit(""), _cell(F.col("description")), F.lit(""), F.concat(F.lit("- 类型：`"), F.coalesce("type", F.lit("")), F.lit("`")), F.concat(F.lit("- 语言：`"), F.coalesce("language", F.lit("")), F.lit("`")),
        F.concat(F.lit("- 卷册/Item："), F.size(rows)), F.lit(""), F.lit("## 卷册"), F.lit(""), F.lit("| 名称 | 章节 | 在线目录 | 完整下载 |"), F.lit("|---|---:|---|---|"), F.when(F.size(rows) > 0, F.array_join(rows, "\n")), F.lit(""),
    )
    return files.unionByName(named.join(table, "dataset", "left").select("dataset", F.concat("folder", F.lit("/README.md")).alias("path"), readme.alias("content")))


def _cell(text: Column) -> Column:
    return markdown_cell(F.coalesce(text.cast("string"), F.lit("")))
