"""Readers. Each gives a DataFrame through Spark's own sources; parsers run on columns."""

from __future__ import annotations

import html
import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from lectern.functions import codecs, dates
from lectern.session import dealt, mounted

SEARCH_DOCUMENT = (
    "documentId string, releaseId string, datasetId string, datasetTitle string, itemId string, itemTitle string, itemType string, revision int, targetId string, "
    "targetType string, targetTitle string, chunkId string, ord int, text string, authors array<string>, publishedDate string, manifestObject string, fragmentObject string"
)


def json_lines(spark: SparkSession, path: str, schema: str = SEARCH_DOCUMENT, partitions: int | None = None) -> DataFrame:
    """JSON lines, also gzipped; blank lines are skipped. A gzip file is one task, so many rows are dealt anew on request."""
    df = spark.read.schema(schema).json(path)
    return df if partitions is None else df.repartition(partitions)


def crawl_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a capture, one row of counts): captured means found, with url and timestamp; the section defaults to unknown."""
    raw = spark.read.schema("url string, date string, section string, wayback_status string, wayback_timestamp string, wayback_digest string").json(path)
    ok = F.coalesce((F.col("wayback_status") == "found") & (F.col("url") != "") & (F.col("wayback_timestamp") != ""), F.lit(False))
    return raw.where(ok).withColumn("section", F.coalesce(F.nullif("section", F.lit("")), F.lit("unknown"))), raw.agg(F.count_if(ok).alias("downloadable"), F.count_if(~ok).alias("skipped"))


def repair_log(spark: SparkSession, folder: str) -> DataFrame:
    """Repair records, one JSON file each, newest first; files that don't parse are skipped."""
    schema = "version int, id string, createdAt string, index string, operation string, replacedDocumentId string, supersedesId string, reason string, state string, appliedAt string, result struct<documentId: string>"
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "repair-*.json")
    return reader.json(folder).where("id IS NOT NULL").orderBy(F.desc("createdAt"))


def excluded_ids(log: DataFrame, index: str) -> DataFrame:
    """(doc_id) that applied repairs of an index took out: what they replaced, and the markers that deletions left."""
    done = log.where((F.col("state") == "applied") & (F.col("index") == index))
    replaced = done.select(F.coalesce("replacedDocumentId", "supersedesId").alias("doc_id"))
    return replaced.union(done.where("operation = 'delete'").select("result.documentId")).where("doc_id IS NOT NULL").distinct()


_ITEM = StructType().add("title", StringType()).add("url", StringType()).add("summary", StringType()).add("content", StringType()).add("published", StringType())


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def _plain(markup: str) -> str | None:
    """Text without tags, entities as characters, white space collapsed; null if nothing is left."""
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", markup)).split()) or None


def parse_feed(body: str | None) -> list[dict]:
    """Items of an RSS, RDF or Atom text; nothing for any other text.

    A field is the first child with text, in document order, of any of its names; the link is the first link's href, else its text. Title, summary and
    content are plain text; summary and content are the same field, at most 500 and 20,000 characters of it.
    """
    try:
        root = ET.fromstring(body or "")
    except ET.ParseError:
        return []
    if _local(root.tag) not in ("rss", "rdf", "feed"):
        return []
    wanted = "entry" if _local(root.tag) == "feed" else "item"

    def first(item, *tags):
        texts = ("".join(child.itertext()).strip() for child in item if _local(child.tag) in tags)
        return next((t for t in texts if t), None)

    out = []
    for item in root.iter():
        if _local(item.tag) != wanted:
            continue
        link = next((c for c in item if _local(c.tag) == "link"), None)
        url = None if link is None else link.get("href") or "".join(link.itertext()).strip() or None
        told = _plain(first(item, "description", "summary", "content", "encoded") or "")
        title, published = first(item, "title"), first(item, "pubdate", "date", "published", "updated")
        out.append({"title": None if title is None else _plain(title) or "", "url": url, "summary": told and told[:500], "content": told and told[:20_000], "published": published})
    return out


@F.arrow_udf(ArrayType(_ITEM))
def _feed_items(bodies: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([(f.name, pa.string()) for f in _ITEM]))
    return pa.array([parse_feed(b) for b in bodies.to_pylist()], kind)


def feed_items(feeds: DataFrame, body: str, untitled: bool = False) -> DataFrame:
    """``feeds`` with one row per item: id (SHA-1 of the url), title, url, summary, content, published.

    Items without title or url are left out; with ``untitled`` all stay.
    """
    items = feeds.withColumn("_i", F.explode(_feed_items(F.col(body))))
    rest = [c for c in feeds.columns if c != body]
    out = items.select(*rest, F.sha1("_i.url").alias("id"), *[F.col(f"_i.{c}").alias(c) for c in ("title", "url", "summary", "content")], dates.feed_time(F.col("_i.published")).alias("published"))
    return out if untitled else out.where("title IS NOT NULL AND url IS NOT NULL")


def source_list_errors(sources: DataFrame) -> DataFrame:
    """(code, id) of what is wrong in sources(version, id, name, language, route, enabled): blank fields, ids twice, routes, none enabled."""
    s = sources.withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    bad = lambda code, cond: s.where(cond).select(F.lit(code).alias("code"), "id")
    blank = F.lit(False)
    for c in ("id", "name", "language", "route"):
        blank = blank | (F.coalesce(F.trim(c), F.lit("")) == "")
    twice = s.groupBy("id").count().where("count > 1").select(F.lit("duplicate").alias("code"), "id")
    none = s.agg(F.count_if(F.col("enabled")).alias("n")).where("n = 0").select(F.lit("none_enabled").alias("code"), F.lit(None).cast("string").alias("id"))
    return bad("version", ~F.col("version").eqNullSafe(F.lit(1))).union(bad("blank", blank)).union(bad("route", ~F.col("route").startswith("/"))).union(twice).union(none)


#: Levels of a tree whose entries are dealt out anew; what is below is walked by the task that has the folder.
LEVELS = 2
#: Names and bytes of files in an Arrow batch.
NAMES, BATCH_BYTES = 10_000, 4 << 20
#: Endings of files that Spark's readers unpack.
PACKED = ("bz2", "deflate", "gz", "lz4", "snappy", "zst")


def _entries(at: str, folder: str, glob: str) -> Iterator[tuple[str, bool]]:
    """(path below ``at``, whether it is a folder) of what a folder holds, without the names and the empty files that Spark's readers leave out."""
    with os.scandir(f"{at}/{folder}") as found:
        for e in found:
            if e.name.startswith(".") or e.name.endswith("._COPYING_") or (e.name.startswith("_") and "=" not in e.name):
                continue
            if e.is_dir():
                yield f"{folder}{e.name}/", True
            elif fnmatchcase(e.name, glob) and e.is_file() and e.stat().st_size:
                yield f"{folder}{e.name}", False


def _tree(spark: SparkSession, at: str, glob: str) -> DataFrame:
    """(path, body) of the files of a mounted tree: tasks list its folders and read its files, so that the driver holds no names and a file costs no task, listing or configuration of its own."""

    def batch(rows: list[tuple[str, bool]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], names=["path", "folder"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for path, folder in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for row in _entries(at, path, glob) if folder else [(path, folder)]:
                    rows.append(row)
                    if len(rows) == NAMES:
                        yield batch(rows)
                        rows = []
        yield batch(rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, bodies, size = [], [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                due = [iter([row])]
                while due:
                    path, folder = next(due[-1], (None, None))
                    if path is None:
                        due.pop()
                    elif folder:
                        due.append(_entries(at, path, glob))
                    else:
                        with open(f"{at}/{path}", "rb") as f:
                            bodies.append(f.read())
                        paths.append(path)
                        size += len(bodies[-1])
                        if size >= BATCH_BYTES or len(paths) == NAMES:
                            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], names=["path", "body"])
                            paths, bodies, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], names=["path", "body"])

    found = spark.range(0, 1, 1, 1).select(F.lit("").alias("path"), F.lit(True).alias("folder"))
    for _ in range(LEVELS):
        found = dealt(found.mapInArrow(listed, "path string, folder boolean"))
    return found.mapInArrow(read, "path string, body binary").select("path", F.col("body").cast("string"))


def markdown_articles(spark: SparkSession, root: str, namespace: str, pattern: str, glob: str = "*.md") -> DataFrame:
    """Articles of a tree of Markdown files: logical_id, path, and the named groups title, date, page, content of ``pattern``.

    A blank page is 0; a file that doesn't match has null fields. A mounted folder is listed and read by tasks; Spark lists and reads other places, and globs of more than ``*``, ``?`` and an ending.
    """
    names = ("title", "date", "page", "content")
    plain = re.fullmatch(r"[\w*?. -]*\.(\w+)", glob)
    at = mounted(spark, root)
    if at is not None and os.path.isdir(at) and plain and plain[1].lower() not in PACKED:
        raw = _tree(spark, at, glob)
    else:
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
        base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
        raw = raw.select(F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), f"^.*?{base}/", "").alias("path"), F.col("value").alias("body"))
    found = F.array(*[F.regexp_extract("body", pattern, i + 1) for i in range(len(names))])
    ok = F.col("body").rlike(pattern)
    out = raw.select("path", F.concat(F.lit(f"{namespace}:"), "path").alias("logical_id"), *[F.when(ok, found[i]).alias(n) for i, n in enumerate(names)])
    return out.withColumn("page", F.when(F.col("page") == "", 0).otherwise(F.col("page").cast("int")))


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("size"))


def issues(paths: DataFrame, path: str = "path") -> DataFrame:
    """(year, issue) of files YYYY/issue.pdf whose six- or eight-digit id begins with the year."""
    part = lambda i: F.regexp_extract(path, r"/([0-9]{4})/([0-9]{6}|[0-9]{8})\.pdf$", i)
    return paths.select(part(1).alias("year"), part(2).alias("issue")).where("issue <> '' AND startswith(issue, year)").distinct()


def by_year(names: DataFrame, name: Column, parent: Column) -> DataFrame:
    """(year, files): distinct sorted names by the parent folder if that is a year, else by the name's first four characters."""
    year = F.when(parent.rlike("^[0-9]{4}$"), parent).otherwise(F.substring(name, 1, 4))
    return names.groupBy(year.alias("year")).agg(F.array_sort(F.collect_set(name)).alias("files"))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, quote="")


def masked_json(spark: SparkSession, root: str, schema: str, glob: str = "*") -> DataFrame:
    """(path, value): JSON objects whose gzipped bytes are masked by their path below ``root``."""
    import gzip

    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")

    @F.arrow_udf(StringType())
    def opened(data: pa.Array, key: pa.Array) -> pa.Array:
        return pa.array([gzip.decompress(codecs.mask(d, k)).decode() for d, k in zip(data.to_pylist(), key.to_pylist(), strict=True)], pa.string())

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    key = F.regexp_replace("path", f"^.*?{base}/", "")
    return raw.select(key.alias("path"), F.from_json(opened("content", key), schema).alias("value"))


def asset_cache(items: DataFrame) -> DataFrame:
    """Per asset url the last path, from items(seq, assets: array<struct<sourceUrl, path>>)."""
    a = items.select("seq", F.posexplode("assets").alias("pos", "a")).where("a.sourceUrl <> '' AND a.path <> ''")
    return a.groupBy(F.col("a.sourceUrl").alias("url")).agg(F.max_by("a.path", F.struct("seq", "pos")).alias("path"))


def page_links(pages: DataFrame, html: str) -> DataFrame:
    """``pages`` with how many page links a listing has and its first attached PDF."""
    return pages.withColumns({"n_pages": F.regexp_count(html, F.lit("pageLink")), "pdf": F.nullif(F.regexp_extract(html, r"""href=["']?([^"'\s>]*attachement[^"'\s>]*\.pdf)""", 1), F.lit(""))})


#: What file names end with, and what reads them.
BOOK_KINDS = {"epub": "epub", "mobi": "mobi", "azw": "mobi", "azw3": "mobi", "json": "reader-export", "md": "markdown", "pdf": "pdf"}


def book_kind(path: Column) -> Column:
    """What reads a file, by its extension in any case; null for others."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in BOOK_KINDS.items() for x in pair])
    return F.try_element_at(kinds, ending)


def archive_entries(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` (say of the binaryFile source) with one row per entry of each zip archive: ``name`` and ``data``; a broken archive is one row with ``error``."""
    rest = [f for f in files.schema.fields if f.name not in (content, "name", "data", "error")]
    schema = StructType([*rest, StructField("name", StringType()), StructField("data", BinaryType()), StructField("error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, rows = batch.slice(i, 1), []
                try:
                    with zipfile.ZipFile(io.BytesIO(row.column(content)[0].as_py() or b"")) as z:
                        rows = [(e.filename, z.read(e), None) for e in z.infolist() if not e.is_dir()]
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError) as e:
                    rows = [(None, None, type(e).__name__)]
                again = row.select([f.name for f in rest]).take(pa.array([0] * len(rows), pa.int64()))
                new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*again.columns, *new], names=schema.names)

    return files.mapInArrow(run, schema)
